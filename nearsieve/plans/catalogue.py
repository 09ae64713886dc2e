"""Registered queries and their DuckDB twins.

``orders`` (the set of parts of an order) stands for short sparse vectors,
character 5-grams of texts for long ones, embeddings for dense ones. Searches
ask with every row whose id is divisible by 20 against all other rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearsieve.config import ORDERS, TEXTS
from nearsieve.functions import scalars
from nearsieve.operators import doph, grams, index, metrics, query, sketch
from nearsieve.plans import oracle as o
from nearsieve.sources import vectors as v

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

PARTS, PAGE, PER_FILE, HEAD, SAMPLE = 4, 1000, 5000, 1000, 500
SETS = o.sets_sql()
EMB = "emb AS (SELECT vec_id AS id, CAST(i AS BIGINT) AS idx, CAST(embedding[i] AS DOUBLE) AS val FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i))"
KNN = [SETS, *o.built(ORDERS), o.index_sql(ORDERS), o.PROBE, o.ranked_sql(ORDERS.top_k)]
DOT = """pd AS (SELECT k.qid, k.id, k.rank, CAST(count(*) AS DOUBLE) AS dot FROM knn k JOIN sets a ON a.id = k.qid JOIN sets b ON b.id = k.id AND b.idx = a.idx GROUP BY 1, 2, 3),
    nn AS (SELECT id, CAST(count(*) AS DOUBLE) AS n2 FROM sets GROUP BY 1),
    pairs AS (SELECT k.qid, k.id, k.rank, coalesce(p.dot, 0.0) AS dot, x.n2 AS qn, y.n2 AS n FROM knn k LEFT JOIN pd p ON p.qid = k.qid AND p.id = k.id JOIN nn x ON x.id = k.qid JOIN nn y ON y.id = k.id)"""


def query_(sql: str | None):
    def add(f: Callable) -> Callable:
        name = f.__name__
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def knn_parts(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """Addresses of all orders, and the index over them."""
    addr = doph.addressed(v.orders(spark, d), ORDERS)
    return addr, index.reservoirs(addr, ORDERS)


def candidates(spark, d: str, lists: bool = True) -> DataFrame:
    addr, idx = knn_parts(spark, d)
    return (query.probe_lists if lists else query.probe)(addr.filter(F.col("id") % query.EVERY == 0), idx)


# --- sources and projections


@query_(o.with_(EMB, then="SELECT id, idx, round(val, 6) AS val FROM emb"))
def sparse_explode(spark, d):
    return v.embeddings(spark, d).select("id", "idx", F.round("val", 6).alias("val"))


@query_(o.with_(SETS, then="SELECT id, CAST(id AS VARCHAR) AS label, idx, 1.0::DOUBLE AS val FROM sets"))
def libsvm_roundtrip(spark, d):
    lines = v.libsvm_lines(v.orders(spark, d).withColumn("val", F.lit(1.0)))
    return v.parse_libsvm(lines, "id", "line").select("id", "label", F.explode(F.arrays_zip("indices", "vals")).alias("x")).select("id", "label", F.col("x.indices").alias("idx"), F.col("x.vals").alias("val"))


@query_(o.with_(SETS, then="SELECT id, max(label) AS label, count(*) AS nnz FROM (SELECT id, CAST(id % 2 AS VARCHAR) AS label FROM sets) GROUP BY 1"))
def labelled_scan(spark, d):
    keyed = v.libsvm_lines(v.orders(spark, d).withColumn("val", F.lit(1.0)), F.col("id") % 2)
    lines = keyed.select(F.concat_ws(" ", F.col("id").cast("string"), "line").alias("value"))
    return v.parse_keyed(lines).select("id", "label", F.size("indices").cast("long").alias("nnz"))


@query_("SELECT CAST(doc_id AS VARCHAR) AS id, length(text) + 1 AS n FROM documents WHERE text IS NOT NULL")
def text_scan(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").filter("text IS NOT NULL")
    lines = docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "text").alias("value"))
    key = F.substring_index("value", ":", 1)
    return lines.select(key.alias("id"), (F.length("value") - F.length(key)).cast("long").alias("n"))


@query_(o.with_(SETS, then=f"SELECT CASE WHEN id < {HEAD} THEN 'query' ELSE 'data' END AS part, count(DISTINCT id) AS n, count(*) AS nnz FROM sets GROUP BY 1"))
def split_head(spark, d):
    part = F.when(F.col("id") < HEAD, "query").otherwise("data")
    return v.orders(spark, d).groupBy(part.alias("part")).agg(F.countDistinct("id").alias("n"), F.count("*").alias("nnz"))


@query_(o.with_(SETS, then=f"SELECT CAST(floor(id / {PAGE}) AS BIGINT) AS batch, count(DISTINCT id) AS n, min(id) AS least, max(id) AS most FROM sets GROUP BY 1"))
def resumable_batches(spark, d):
    return v.batches(v.orders(spark, d), PAGE).groupBy("batch").agg(F.countDistinct("id").alias("n"), F.min("id").alias("least"), F.max("id").alias("most"))


@query_(f"""WITH ids AS (SELECT DISTINCT l_orderkey AS id FROM lineitem), t AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS r, count(*) OVER () AS n FROM ids),
p AS (SELECT id, CASE WHEN r < (n % {PARTS}) * (n // {PARTS} + 1) THEN r // (n // {PARTS} + 1) ELSE n % {PARTS} + (r - (n % {PARTS}) * (n // {PARTS} + 1)) // (n // {PARTS}) END AS part FROM t)
SELECT CAST(part AS BIGINT) AS part, count(*) AS n, min(id) AS least, max(id) AS most FROM p GROUP BY 1""")
def range_partition(spark, d):
    ids = v.orders(spark, d).select("id").distinct()
    return contiguous(ids, PARTS).groupBy("part").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.max("id").alias("most"))


def contiguous(ids: DataFrame, parts: int) -> DataFrame:
    """``id, part``: balanced contiguous ranges, the first n mod parts one longer.

    Row numbers come from counts of slices of PAGE ids, summed within groups of slices, and of groups:
    a task numbers a slice or sums a group, and one task sums a number for each PAGE * 10,000 ids.
    """
    near = ids.withColumn("slice", F.floor(F.col("id") / PAGE).cast("long"))
    place = F.row_number().over(Window.partitionBy("slice").orderBy("id")) - 1
    counts = near.groupBy("slice").agg(F.count("*").alias("c")).withColumn("many", F.floor(F.col("slice") / 10_000).cast("long"))
    upto = lambda w: F.coalesce(F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = counts.groupBy("many").agg(F.sum("c").alias("c")).select("many", upto(Window.orderBy("many")).alias("above"))
    before = counts.withColumn("inner", upto(Window.partitionBy("many").orderBy("slice"))).join(groups, "many").select("slice", (F.col("inner") + F.col("above")).alias("before"))
    total = counts.agg(F.sum("c").alias("n"))
    r = near.withColumn("place", place).join(before, "slice").join(F.broadcast(total), how="cross").withColumn("r", F.col("place") + F.col("before"))
    long_, size = f"(n % {parts}) * (n div {parts} + 1)", f"(n div {parts})"
    return r.select("id", F.expr(f"CASE WHEN r < {long_} THEN r div ({size} + 1) ELSE n % {parts} + (r - {long_}) div {size} END").alias("part"))


@query_(o.with_(SETS, then=f"SELECT 'part' || lpad(CAST(f AS VARCHAR), 2, '0') AS file, count(*) AS n FROM (SELECT DISTINCT id, id // {PER_FILE} AS f FROM sets) GROUP BY 1"))
def file_routing(spark, d):
    file = v.file_name(F.expr(f"id div {PER_FILE}"), "part")
    return v.orders(spark, d).select("id").distinct().groupBy(file.alias("file")).agg(F.count("*").alias("n"))


# --- files, written and read again

LINES = "lines AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS line FROM (SELECT DISTINCT id FROM sets))"


@query_(o.with_(SETS, LINES, then=f"SELECT line AS id, CAST(s.id AS VARCHAR) AS label, idx, 1.0::DOUBLE AS val FROM sets s JOIN lines l ON l.id = s.id WHERE line >= {PAGE} AND line < {PAGE + PER_FILE}"))
def libsvm_files(spark, d):
    """Orders as libsvm files of PAGE lines, read from line PAGE on."""
    path = v.scratch(spark, "libsvm")
    v.write_libsvm(v.orders(spark, d).withColumn("val", F.lit(1.0)), path, PAGE * 3 // 4)
    rows = v.read_libsvm(spark, path, PAGE, PER_FILE)
    return rows.select("id", "label", F.explode(F.arrays_zip("indices", "vals")).alias("x")).select("id", "label", F.col("x.indices").alias("idx"), F.col("x.vals").alias("val"))


@query_(o.with_(SETS, f"parts AS (SELECT id, id // {PER_FILE} AS part, row_number() OVER (PARTITION BY id // {PER_FILE} ORDER BY id) - 1 AS line FROM (SELECT DISTINCT id FROM sets))",
    then=f"SELECT CAST(part * {PER_FILE} + line AS BIGINT) AS id, CAST(id AS VARCHAR) AS label, (SELECT count(*) FROM sets s WHERE s.id = parts.id) AS nnz FROM parts"))
def partitioned_files(spark, d):
    """Orders in a part for every PER_FILE ids, read by part number and line."""
    path = v.scratch(spark, "parts")
    v.write_partitioned(v.orders(spark, d).withColumn("val", F.lit(1.0)), path, "part", PER_FILE)
    return v.read_partitioned(spark, path, "part", PER_FILE).select("id", "label", F.size("indices").cast("long").alias("nnz"))


@query_(f"SELECT CAST(doc_id AS VARCHAR) AS id, length(text) + 1 AS n, md5(':' || translate(text, chr(10) || chr(13), '  ')) AS digest FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS line FROM documents WHERE text IS NOT NULL) WHERE line > {SAMPLE // 5}")
def text_files(spark, d):
    """Documents as lines of text files of uneven size, read but for the first lines."""
    path = v.scratch(spark, "texts")
    v.write_texts(v.texts(spark, d), path, PAGE // 7)
    return v.read_texts(spark, path, SAMPLE // 5).select("id", F.length("text").cast("long").alias("n"), F.md5(F.encode("text", "UTF-8")).alias("digest"))


@query_(o.with_(*KNN, then="SELECT dense_rank() OVER (ORDER BY qid) - 1 AS qid, rank, id FROM knn"))
def top_k_files(spark, d):
    """Neighbours as lines of files of uneven size; read back, a query is its line."""
    path = v.scratch(spark, "topk")
    v.write_top_k(knn_exact_count(spark, d), path, PAGE // 7)
    return v.read_top_k(spark, path)


# --- text


@query_("SELECT doc_id AS id, greatest(coalesce(length(text), 0) - 4, 0) AS n FROM documents")
def ngram_counts(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select(F.col("doc_id").alias("id"), F.coalesce(F.size(scalars.char_ngrams(F.col("text"), 5)), F.lit(0)).cast("long").alias("n"))


@query_(o.with_(o.sets_sql("grams", o.grams_sql("documents", "doc_id")), then="SELECT id, (idx >> 11) & 1048575 AS bucket, min(idx) AS h FROM grams GROUP BY 1, 2"))
def ngram_bucket_min(spark, d):
    return grams.bucket_minima(v.texts(spark, d), 11, 20)


@query_(o.with_(o.sets_sql("grams", o.grams_sql("documents", "doc_id")), then="SELECT count(*) AS vectors, max(n) AS max_nnz, CAST(floor(avg(n)) AS BIGINT) AS avg_nnz FROM (SELECT id, count(*) AS n FROM grams GROUP BY 1)"))
def ngram_stats(spark, d):
    sizes = grams.set_sizes(v.texts(spark, d)).filter("n > 0")
    return sizes.agg(F.count("*").alias("vectors"), F.max("n").alias("max_nnz"), F.floor(F.avg("n")).cast("long").alias("avg_nnz"))


# --- hashing and the index


@query_(o.with_(SETS, o.hashes_sql(ORDERS, "sets"), then="SELECT id, idx, h FROM fh"))
def feature_hash(spark, d):
    return v.orders(spark, d).select("id", "idx", doph.feature_hash(F.col("idx"), ORDERS).alias("h"))


@query_(o.with_(SETS, o.hashes_sql(ORDERS, "sets"), o.bins_sql(ORDERS), then="SELECT id, CAST(bin AS INTEGER) AS bin, h FROM bins"))
def doph_bins(spark, d):
    return doph.bins(v.orders(spark, d), ORDERS)


@query_(o.with_(SETS, *o.built(ORDERS)[:3], then="SELECT id, CAST(bin AS INTEGER) AS bin, h FROM sig"))
def doph_densified(spark, d):
    return doph.signatures(v.orders(spark, d), ORDERS).select("id", F.posexplode("sig").alias("bin", "h"))


@query_(o.with_(SETS, *o.built(ORDERS), then="SELECT id, tbl, bucket FROM addr"))
def bucket_address(spark, d):
    return doph.addressed(v.orders(spark, d), ORDERS)


@query_(o.with_(o.sets_sql("grams", o.grams_sql("documents", "doc_id")), *o.built(TEXTS, "grams"), then="SELECT id, tbl, bucket FROM addr"))
def bucket_address_texts(spark, d):
    return doph.addressed(grams.features(v.texts(spark, d)), TEXTS)


@query_(o.with_(SETS, *o.built(ORDERS), then=f"SELECT round(min(s), 6) AS min_share, round(max(s), 6) AS max_share, round(avg(s), 6) AS avg_share FROM (SELECT tbl, count(DISTINCT bucket) / {float(2**ORDERS.address_bits)} AS s FROM addr GROUP BY 1)"))
def bucket_occupancy(spark, d):
    found = index.occupancy(doph.addressed(v.orders(spark, d), ORDERS), ORDERS)
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@query_(o.with_(SETS, *o.built(ORDERS), o.index_sql(ORDERS), then="SELECT tbl, bucket, slot, id, n_seen FROM idx"))
def reservoir_index(spark, d):
    return knn_parts(spark, d)[1]


@query_(ORACLES["reservoir_index"])
def incremental_index(spark, d):
    """Even orders first, odd ones merged into their index."""
    addr = doph.addressed(v.orders(spark, d), ORDERS)
    first = index.persisted(index.reservoirs(addr.filter("id % 2 = 0"), ORDERS), v.scratch(spark, "index"))
    return index.merge_index(first, addr.filter("id % 2 <> 0"), ORDERS)


@query_(o.with_(*KNN[:-1], then="SELECT qid, tbl, slot, id FROM cand"))
def probe_candidates(spark, d):
    return candidates(spark, d, lists=False)


# --- top-K


@query_(o.with_(*KNN, then="SELECT qid, rank, id, n FROM knn"))
def knn_exact_count(spark, d):
    return query.top_by_count(candidates(spark, d), ORDERS.top_k)


@query_(ORACLES["knn_exact_count"])
def batched_query(spark, d):
    addr, idx = knn_parts(spark, d)
    kept = index.persisted(idx, v.scratch(spark, "index"))  # built once, read by each batch
    return query.batched(addr.filter(F.col("id") % query.EVERY == 0), kept, ORDERS, PARTS)


@query_(o.with_(o.sets_sql("grams", o.grams_sql("documents", "doc_id")), o.sets_sql("items", o.grams_sql("benchmark", "item_id")), *o.built(TEXTS, "grams"), o.index_sql(TEXTS), *o.built(TEXTS, "items", "q"),
    "cand AS (SELECT q.id AS qid, i.tbl, i.slot, i.id FROM qaddr q JOIN idx i ON i.tbl = q.tbl AND i.bucket = q.bucket)", o.ranked_sql(TEXTS.top_k), then="SELECT qid, rank, id, n FROM knn"))
def knn_contamination(spark, d):
    """Test items against documents: two id spaces, so equal numbers are no self-match."""
    idx = index.reservoirs(doph.addressed(grams.features(v.texts(spark, d)), TEXTS), TEXTS)
    asked = doph.addressed(grams.features(v.texts(spark, d, "benchmark", "item_id")), TEXTS)
    return query.top_by_count(query.probe_lists(asked, idx), TEXTS.top_k, own=True)


ITEMS = "SELECT qid, id AS item, {'tbl': tbl, 'slot': slot, 'item': id} AS o FROM cand"
PARTED = "SELECT qid, id % 4 AS part, id AS item, {'tbl': tbl, 'slot': slot, 'item': id} AS o FROM cand"


@query_(o.with_(*KNN[:-1], o.sketch_sql(ORDERS, "qid", ITEMS, "o"), then="SELECT qid, CAST(row AS INTEGER) AS row, cell, hh, cnt FROM cells"))
def sketch_cells(spark, d):
    return sketch.sketch(candidates(spark, d), ORDERS, ["qid"], ["tbl"], "ids", without="qid")


def parted(spark, d: str, rows: int | None = 1) -> DataFrame:
    """Cells of each query's candidates in PARTS parts; row 0 is all that a ranking without a threshold reads."""
    each = F.explode(F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda p: F.struct(p.cast("long").alias("part"), F.filter("ids", lambda x: F.pmod(x, F.lit(PARTS)) == p).alias("ids"))))
    lists = candidates(spark, d).select("qid", "tbl", each.alias("x")).select("qid", "tbl", "x.*")
    return sketch.sketch(lists, ORDERS, ["qid", "part"], ["tbl"], "ids", rows, without="qid")


TOP = "SELECT qid, hh AS id, cnt AS n FROM {} WHERE row = 0 AND cnt > 0"


@query_(o.with_(*KNN[:-1], o.sketch_sql(ORDERS, "qid, part", PARTED, "o"), o.merge_sql("whole", "cells", "qid", "part"), o.ranked_sql(ORDERS.top_k, "best", TOP.format("whole")), then="SELECT qid, rank, id, n FROM best"))
def knn_sketch_linear(spark, d):
    return sketch.sketch_top_k(sketch.linear_merge(parted(spark, d), ["qid"]), ORDERS, ORDERS.top_k)


@query_(o.with_(*KNN[:-1], o.sketch_sql(ORDERS, "qid, part", PARTED, "o"), o.merge_sql("half", "(SELECT *, part // 2 AS up FROM cells)", "qid, up", "part"), o.merge_sql("whole", "half", "qid", "up"), o.ranked_sql(ORDERS.top_k, "best", TOP.format("whole")), then="SELECT qid, rank, id, n FROM best"))
def knn_sketch_tree(spark, d):
    return sketch.sketch_top_k(sketch.tree_merge(parted(spark, d), ["qid"], PARTS), ORDERS, ORDERS.top_k)


LEAST = 3
OTHER = " UNION ALL ".join(f"SELECT qid, hh AS id, {r} AS row, {o.mul(f'((hh + 1) & {o.MASK})', m)} >> {32 - ORDERS.sketch_bits} AS cell FROM low" for r, m in enumerate(ORDERS.constants["rows"]) if r)


@query_(o.with_(*KNN[:-1], o.sketch_sql(ORDERS, "qid", ITEMS, "o"), f"low AS (SELECT qid, hh FROM cells WHERE row = 0 AND cnt < {LEAST})", f"other AS ({OTHER})",
    f"other_n AS (SELECT o.qid, o.id, arg_min(c.cnt, o.row) AS n FROM other o JOIN cells c ON c.qid = o.qid AND c.row = o.row AND c.cell = o.cell WHERE c.cnt > {LEAST} GROUP BY 1, 2)",
    o.ranked_sql(ORDERS.top_k, "best", f"SELECT qid, hh AS id, cnt AS n FROM cells WHERE row = 0 AND cnt >= {LEAST} UNION ALL SELECT qid, id, n FROM other_n"), then="SELECT qid, rank, id, n FROM best"))
def knn_sketch_threshold(spark, d):
    """Ids that the first row counts less than LEAST times are judged by the other rows."""
    return sketch.sketch_top_k(sketch_cells(spark, d), ORDERS, ORDERS.top_k, LEAST)


@query_(None)
def knn_approx_top_k(spark, d):
    """The engine's own mergeable sketch; counts are estimates."""
    found = candidates(spark, d, lists=False).groupBy("qid").agg(F.expr(f"approx_top_k(id, {ORDERS.top_k}, 1000)").alias("t"))
    return found.select("qid", F.posexplode("t").alias("rank", "x")).select("qid", "rank", F.col("x.item").alias("id"), F.col("x.count").alias("n"))


@query_("SELECT rank, id, n FROM (SELECT CAST(row_number() OVER (ORDER BY n DESC, id) - 1 AS INTEGER) AS rank, id, n FROM (SELECT user_id AS id, count(*) AS n FROM events GROUP BY 1)) WHERE rank < 10")
def heavy_hitters_users(spark, d):
    """Most frequent users, counted exactly and cut to a top ten before numbering."""
    counts = spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "id").limit(ORDERS.top_k).withColumn("qid", F.lit(0))
    return query.ranked(top, ORDERS.top_k).select("rank", "id", "n")


STREAM = 5000  # events of a part of the stream


@query_(o.with_(o.sketch_sql(ORDERS, "qid, part", f"SELECT 0 AS qid, event_id // {STREAM} AS part, user_id AS item, {{'e': event_id, 'item': user_id}} AS o FROM events", "o"), o.merge_sql("whole", "cells", "qid", "part"), o.ranked_sql(ORDERS.top_k, "best", TOP.format("whole")), then="SELECT rank, id, n FROM best"))
def heavy_hitters_sketch(spark, d):
    """Most frequent users by the sketch: a part of the stream is folded by one task, parts are merged in order."""
    events = spark.read.parquet(f"{d}/events.parquet").select(F.lit(0).alias("qid"), F.expr(f"event_id div {STREAM}").alias("part"), "event_id", F.col("user_id").alias("id"))
    cells = sketch.sketch(events, ORDERS, ["qid", "part"], ["event_id"], rows=1)
    return sketch.sketch_top_k(sketch.linear_merge(cells, ["qid"]), ORDERS, ORDERS.top_k).select("rank", "id", "n")


@query_(o.with_(SETS, """sz AS (SELECT id, count(*) AS s FROM sets GROUP BY 1), both_ AS (SELECT a.id AS qid, b.id, count(*) AS c FROM sets a JOIN sets b ON a.idx = b.idx AND a.id <> b.id WHERE a.id % 20 = 0 GROUP BY 1, 2),
    j AS (SELECT qid, b.id, round(c / CAST(x.s + y.s - c AS DOUBLE), 6) AS jaccard FROM both_ b JOIN sz x ON x.id = qid JOIN sz y ON y.id = b.id)""",
    then="SELECT * FROM (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY jaccard DESC, id) - 1 AS INTEGER) AS rank, id, jaccard FROM j) WHERE rank < 10"))
def exact_jaccard_knn(spark, d):
    return query.exact_jaccard(v.orders(spark, d), ORDERS.top_k)


@query_(o.with_(*KNN, f"truth AS ({ORACLES['exact_jaccard_knn'].replace('WITH ' + SETS + ',', 'WITH', 1)})", then="SELECT count(*) AS truth, count(k.id) AS found, round(count(k.id) / CAST(count(*) AS DOUBLE), 6) AS recall FROM truth t LEFT JOIN knn k ON k.qid = t.qid AND k.id = t.id"))
def recall_at_k(spark, d):
    found = metrics.recall(knn_exact_count(spark, d), exact_jaccard_knn(spark, d))
    return found.withColumn("recall", F.round("recall", 6))


@query_(None)
def minhash_lsh_baseline(spark, d):
    """The library's MinHash join of the queries with all orders; empty vectors never occur here."""
    from pyspark.ml.feature import HashingTF, MinHashLSH

    sets = v.orders(spark, d).groupBy("id").agg(F.collect_set(F.col("idx").cast("string")).alias("terms"))
    counted = HashingTF(inputCol="terms", outputCol="features", binary=True, numFeatures=1 << 30).transform(sets)  # no vocabulary to collect
    model = MinHashLSH(inputCol="features", outputCol="hashes", numHashTables=ORDERS.tables, seed=ORDERS.seed).fit(counted)
    near = model.approxSimilarityJoin(counted.filter(F.col("id") % query.EVERY == 0), counted, 0.9, "distance")
    return near.select(F.col("datasetA.id").alias("qid"), F.col("datasetB.id").alias("id"), F.round("distance", 6).alias("distance")).filter("qid <> id")


# --- similarities and quality


NEXT = "nx AS (SELECT a.id AS qid, b.id AS id, sum(a.val * b.val) AS dot FROM emb a JOIN emb b ON b.id = a.id + 1 AND b.idx = a.idx GROUP BY 1, 2), n2 AS (SELECT id, sum(val * val) AS n FROM emb GROUP BY 1)"


def next_pairs(spark, d: str) -> DataFrame:
    ids = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("qid"))
    return ids.withColumn("id", F.col("qid") + 1).join(ids.withColumnRenamed("qid", "id"), "id", "left_semi").select("qid", "id")


@query_(o.with_(EMB, NEXT, then="SELECT qid, id, round(dot, 5) AS dot FROM nx"))
def sparse_dot(spark, d):
    return metrics.pair_dots(next_pairs(spark, d), v.embeddings(spark, d)).select("qid", "id", F.round("dot", 5).alias("dot"))


@query_(o.with_(EMB, NEXT, then="SELECT qid, nx.id, round(dot / sqrt(a.n * b.n), 5) AS cosine FROM nx JOIN n2 a ON a.id = qid JOIN n2 b ON b.id = nx.id"))
def sparse_cosine(spark, d):
    return metrics.pair_cosines(next_pairs(spark, d), v.embeddings(spark, d)).select("qid", "id", F.round("cosine", 5).alias("cosine"))


@query_("SELECT a.vec_id AS qid, b.vec_id AS id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def dense_cosine(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    a = rows.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("x"), (F.col("vec_id") + 1).alias("id"))
    pairs = a.join(rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("y")), "id")
    return pairs.select("qid", "id", F.round(scalars.dense_cosine(F.col("x"), F.col("y")), 5).alias("cosine"))


@query_(o.with_(*KNN, DOT, then="SELECT qid, id, round(dot / (qn + n - dot), 6) AS jaccard FROM pairs"))
def jaccard(spark, d):
    sets = v.orders(spark, d).groupBy("id").agg(F.collect_list("idx").alias("s"))
    pairs = knn_exact_count(spark, d).select("qid", "id").join(sets, "id").join(sets.select(F.col("id").alias("qid"), F.col("s").alias("q")), "qid")
    return pairs.select("qid", "id", F.round(scalars.jaccard(F.col("q"), F.col("s")), 6).alias("jaccard"))


def at_k(spark, d: str, ks: list[int]) -> DataFrame:
    long = v.orders(spark, d).withColumn("val", F.lit(1.0))
    asked = long.filter(F.col("id") % query.EVERY == 0).agg(F.countDistinct("id")).first()[0]
    found = query.top_by_count(candidates(spark, d), max(ks))
    return metrics.similarity_at(found, long, asked, ks).select("k", F.round("similarity", 6).alias("similarity"))


def at_k_sql(ks: list[int]) -> str:
    rows = " UNION ALL ".join(f"SELECT {k} AS k, round(coalesce(sum(CASE WHEN rank < {k} THEN dot / sqrt(qn * n) END), 0) / ((SELECT count(DISTINCT id) FROM sets WHERE id % 20 = 0) * {k}), 6) AS similarity FROM pairs" for k in ks)
    return o.with_(*KNN[:-1], o.ranked_sql(max(ks)), DOT, then=f"SELECT CAST(k AS INTEGER) AS k, similarity FROM ({rows})")


@query_(at_k_sql([1, 2, 3, 5]))
def s_at_k_small(spark, d):
    return at_k(spark, d, [1, 2, 3, 5])


@query_(at_k_sql([1, 10, 20, 30, 32, 40, 50, 64, 100]))
def s_at_k(spark, d):
    return at_k(spark, d, [1, 10, 20, 30, 32, 40, 50, 64, 100])


@query_(o.with_(*KNN, DOT, then="SELECT qid, rank, round(avg(dot / sqrt(qn * n)) OVER (PARTITION BY qid ORDER BY rank), 6) AS mean FROM pairs"))
def prefix_mean_similarity(spark, d):
    found = knn_exact_count(spark, d)
    scored = found.select("qid", "rank", "id").join(metrics.pair_cosines(found, v.orders(spark, d).withColumn("val", F.lit(1.0))), ["qid", "id"])
    return metrics.prefix_means(scored, "cosine").select("qid", "rank", F.round("mean", 6).alias("mean"))


@query_("WITH p AS (SELECT a.vec_id AS i, avg(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS c FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY 1) SELECT round(avg(c), 6) AS mean_cosine FROM p")
def mean_pairwise_cosine(spark, d):
    return metrics.mean_pairwise_cosine(v.embeddings(spark, d)).select(F.round("mean_cosine", 6).alias("mean_cosine"))


@query_(o.with_(*KNN, DOT, then="SELECT round(avg(s), 6) AS similarity FROM (SELECT qid, avg(dot / (qn * n)) AS s FROM pairs GROUP BY 1)"))
def norm2_similarity(spark, d):
    found = metrics.norm2_similarity(knn_exact_count(spark, d), v.orders(spark, d).withColumn("val", F.lit(1.0)))
    return found.select(F.round("similarity", 6).alias("similarity"))


@query_(o.with_(*KNN, then="SELECT id, idx FROM sets WHERE id IN (SELECT id FROM knn)"))
def topk_semi_join(spark, d):
    return v.orders(spark, d).join(knn_exact_count(spark, d).select("id").distinct(), "id", "left_semi")


@query_(o.with_(*KNN, then=f"SELECT id // {PER_FILE} AS part, count(DISTINCT id) AS n FROM knn GROUP BY 1"))
def distinct_results(spark, d):
    return knn_exact_count(spark, d).groupBy(F.expr(f"id div {PER_FILE}").alias("part")).agg(F.countDistinct("id").alias("n"))


@query_(o.with_(*KNN, then="SELECT qid, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY rank) AS line FROM knn GROUP BY 1"))
def top_k_lines(spark, d):
    ranked = F.array_sort(F.collect_list(F.struct("rank", "id")))
    return knn_exact_count(spark, d).groupBy("qid").agg(ranked.alias("r")).select("qid", F.concat_ws(" ", F.transform("r", lambda r: r["id"].cast("string"))).alias("line"))


@query_(o.with_(SETS, then=f"SELECT id FROM (SELECT DISTINCT id FROM sets) ORDER BY md5('3:' || CAST(id AS VARCHAR)), id LIMIT {SAMPLE}"))
def sample_ids(spark, d):
    return metrics.sample_rows(v.orders(spark, d).select("id").distinct(), SAMPLE)


@query_("SELECT c_custkey AS id, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_samp(c_acctbal) FROM customer), 6) AS z FROM customer")
def z_center(spark, d):
    rows = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), "c_acctbal")
    return metrics.z_scores(rows, "id", "c_acctbal").select("id", F.round("z", 6).alias("z"))


@query_("SELECT p_partkey AS id, CAST(CASE WHEN p_size < 2 THEN 0 ELSE floor(log2(p_size)) + 1 END AS INTEGER) AS bits, CAST(CASE WHEN p_size < 0 THEN 0 WHEN p_size <= 1 THEN 1 ELSE pow(2, ceil(log2(p_size))) END AS BIGINT) AS up FROM part")
def int_log2_pow2(spark, d):
    size = F.col("p_size").cast("long")
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), scalars.bit_length(size).alias("bits"), scalars.next_power_of_two(size).alias("up"))
