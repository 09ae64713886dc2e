"""Near copies by the exact Jaccard similarity of their five-word shingles.

Candidates are documents that agree in one of BANDS bands of ROWS minima; a pair
at LEAST is missed with probability (1 - 0.8^5)^24 = 7e-5. Each bucket is a star
to its least document first, then to others while those join many; only members
that are still in different classes then meet in pairs, each pair once and only
if its bounds allow 0.8. Every candidate is verified by its whole shingle sets.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearsieve.llm.env import cut, slices
from nearsieve.llm.graph import components
from nearsieve.llm.simhash import fingerprints, links
from nearsieve.llm.words import Words, mix

SHINGLE = 5
BANDS, ROWS = 24, 5
KEYS = [f"k{b}" for b in range(BANDS)]
WORDS = 32  # of 64 bits: whether the number of a text's shingles at each of 2,048 places is odd
SLICE = 1 << 20  # bytes of text worked on at once
PRODUCTIVE = 0.1  # share of the members met that a round of stars has to join for another round
FACTORS = np.array([random.Random(31 + i).getrandbits(64) | 1 for i in range(BANDS * ROWS)], np.uint64)


def _sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in order, the start of each text's, and the texts that have any."""
    words = Words(batch.column("text"))
    h, at = words.shingles(SHINGLE)
    row = words.row[at]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    texts, starts = np.unique(row, return_index=True)
    return h, starts, texts


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SLICE):
        h, starts, texts = _sets(batch)
        if not len(texts):
            continue
        keys = []
        for b in range(BANDS):
            key = np.zeros(len(texts), np.uint64)
            for f in FACTORS[b * ROWS : (b + 1) * ROWS]:
                key = mix(key ^ np.minimum.reduceat(h * f, starts))
            keys.append(key)
        same = np.add.reduceat(mix(h), starts)  # of the whole set
        which = pa.array(texts)
        yield pa.record_batch([batch.column("node").take(which), batch.column("doc_id").take(which), pa.array(same.view(np.int64)), *(pa.array(k.view(np.int64)) for k in keys)], ["doc", "id", "same", *KEYS])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SLICE):
        h, starts, texts = _sets(batch)
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(h)).astype(np.int32)), pa.array(h.view(np.int64)))
        sizes = np.diff(np.append(starts, len(h)))
        parity = _parity(h, np.repeat(np.arange(len(texts)), sizes), len(texts)).view(np.int64)
        odd = pa.ListArray.from_arrays(pa.array(np.arange(0, len(parity) + 1, WORDS, dtype=np.int32)), pa.array(parity))
        yield pa.record_batch([batch.column("node").take(pa.array(texts)), lists, pa.array(sizes.astype(np.int64)), odd], ["doc", "s", "size", "odd"])


def _parity(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """WORDS words a row. Two rows differ in as many bits at most as their sets differ in shingles."""
    out, place = np.zeros(rows * WORDS, np.uint64), mix(h) % np.uint64(64 * WORDS)
    np.bitwise_xor.at(out, row * WORDS + (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return out


def _shingle_sets(rows: DataFrame, texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """``doc, s, size, odd``: the shingles of each text in ``pairs(a, b)``; one row of each text is read for it."""
    nodes = pairs.select("a").union(pairs.select("b")).distinct().toDF("node")
    asked = texts.join(nodes, "node", "left_semi").select(F.col("node").alias("own"), F.col("first.id").alias("own_id"))
    own = rows.join(asked, (rows["node"] == asked["own"]) & rows["doc_id"].eqNullSafe(asked["own_id"]), "left_semi")
    return cut(own.dropDuplicates(["node"]).mapInArrow(_shingles, "doc binary, s array<long>, size long, odd array<long>"), "shingles")


def _scored(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs(a, b)`` with the number ``n`` of shingles that both have, and ``m``, the sum of their numbers."""
    lists = sets.select("doc", "s")
    both = pairs.join(lists.toDF("a", "x"), "a").join(lists.toDF("b", "y"), "b")
    return both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("n"), (F.size("x") + F.size("y")).alias("m"))


def _linked(scored: DataFrame) -> DataFrame:
    """The pairs whose Jaccard similarity is 0.8 or more."""
    return scored.filter("5 * n >= 4 * (m - n)").select("a", "b")


def text_classes(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """``node, root`` of the texts of ``rows(node, doc_id, text)`` that are linked to another. A node names a
    text; ``texts(node, first)`` has each once, with the id of a row."""
    prints = cut(fingerprints(rows, name="node").groupBy("node").agg(F.first("fp").alias("fp")), "prints")
    values = cut(prints.groupBy("fp").agg(F.min("node").alias("least")), "values")
    rooted = values.join(components(links(values)).withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("b")), "root").select("fp", "b")
    near = prints.join(rooted, "fp").select(F.col("node").alias("a"), "b")
    schema = "doc binary, id long, same long, " + ", ".join(f"{k} long" for k in KEYS)
    bands = rows.mapInArrow(_bands, schema).groupBy("doc").agg(F.coalesce(F.min("id"), F.lit((1 << 63) - 1)).alias("id"), *[F.first(c).alias(c) for c in ("same", *KEYS)])  # copies agree
    # stars have the text of least id for a centre: one that most of its copies meet in most of their buckets
    name = F.struct("id", "doc")
    bands = cut(bands.select("doc", "id", "same", F.array(*KEYS).alias("keys")), "bands")
    firsts = cut(bands.groupBy("same").agg(F.min(name).alias("x")).select("same", F.col("x.doc").alias("first")), "firsts")
    equal = bands.join(firsts, "same").select(F.col("doc").alias("a"), F.col("first").alias("b"))
    edges = cut(near.union(equal), "edges")
    single = bands.join(firsts.select(F.col("first").alias("doc"), "same"), ["doc", "same"], "left_semi")
    buckets = cut(single.select("doc", "id", F.posexplode("keys").alias("band", "key")), "buckets")
    stars = cut(buckets.groupBy("band", "key").agg(F.min(name).alias("a"), F.max(name).alias("z")).filter("a.doc <> z.doc").select("band", "key", F.col("a.doc").alias("a")), "stars")
    members = cut(buckets.join(stars, ["band", "key"]).select("band", "key", "doc", "a"), "members")
    pairs = cut(members.filter("doc <> a").select("a", F.col("doc").alias("b")).distinct(), "pairs")
    sets = _shingle_sets(rows, texts, pairs)  # of every member of a star, so of all that meet below too
    scored = cut(_scored(sets, pairs), "scored")
    edges = cut(edges.union(_linked(scored)), "edges")
    roots = components(edges)
    far = scored.select("a", F.col("b").alias("doc"), F.expr("1 - n / (m - n)").alias("far"))
    placed = members.join(far, ["a", "doc"], "left").select("band", "key", "doc", F.coalesce("far", F.lit(0.0)).alias("far"), (F.col("doc") == F.col("a")).alias("tried"))
    placed = placed.join(roots.withColumnRenamed("node", "doc"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    tops = joined(cut(_open(placed, "root"), "left"), bands, sets)
    if tops is None:
        return roots
    tops = cut(tops, "tops")
    known = roots.join(tops.toDF("root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return known.union(tops.toDF("node", "root").join(roots, "node", "left_anti"))


def _open(rows: DataFrame, root: str) -> DataFrame:
    """The rows of buckets whose members are of several classes."""
    several = rows.groupBy("band", "key").agg(F.min(root).alias("r"), F.max(root).alias("q")).filter("r <> q").select("band", "key")
    return rows.join(several, ["band", "key"], "left_semi")


def _may(top: str) -> str:
    """Whether the members ``x`` and ``y`` of a bucket could be near, though in different classes. Jaccard distance is a
    metric, so their distances from one centre differ by 0.2 at most; and near sets differ in a ninth of their sizes' sum at most."""
    differ = "aggregate(zip_with(x.odd, y.odd, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v)"
    return f"x.{top} <> y.{top} AND abs(x.far - y.far) <= 0.2 + 1e-9 AND 9 * abs(x.size - y.size) <= x.size + y.size AND 9 * {differ} <= x.size + y.size"


def joined(left: DataFrame, bands: DataFrame, sets: DataFrame) -> DataFrame | None:
    """``node, root`` of the classes that links between members of the buckets ``left(band, key, doc, far, tried, root)`` join,
    named by their ``root``; None if there are none.

    Another star is drawn in every bucket, from a member of a class that no centre was of, while such stars join many. What is then
    in different classes meets in pairs, in the first band that a pair agrees in, so every link is found and no pair made twice.
    """
    named = left.join(bands.select("doc", "id", "keys"), "doc").join(sets.select("doc", "size", "odd"), "doc")
    rows, tops, links = named.withColumn("top", F.col("root")), None, None

    def found(pairs: DataFrame) -> DataFrame:
        roots = left.select("doc", "root").distinct()
        near = _linked(_scored(sets, pairs)).join(roots.toDF("a", "ra"), "a").join(roots.toDF("b", "rb"), "b")
        return cut(near.select("b", F.col("ra").alias("x"), F.col("rb").alias("y")), "links")

    def classes(edges: DataFrame) -> DataFrame:
        return components(edges.select(F.col("x").alias("a"), F.col("y").alias("b")))

    while True:
        rows = cut(_open(rows, "top"), "rows")
        fresh = rows.join(rows.filter("tried").select("band", "key", "top").distinct(), ["band", "key", "top"], "left_anti")
        centres = fresh.groupBy("band", "key").agg(F.min(F.struct("id", "doc")).alias("c")).select("band", "key", F.col("c.doc").alias("doc"))
        centres = cut(centres, "centres")
        if not centres.head(1):
            break
        hubs = rows.join(centres, ["band", "key", "doc"])
        pairs = hubs.alias("x").join(rows.alias("y"), ["band", "key"]).filter(_may("top")).select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).distinct()
        new = found(pairs)
        met, got = rows.select("doc").distinct().count(), new.select("b").distinct().count()
        if got:
            links = new if links is None else links.union(new)
            tops = classes(links)
            rows = rows.drop("top").join(tops.toDF("root", "top"), "root", "left").withColumn("top", F.coalesce("top", "root"))
        rows = rows.join(centres.withColumn("now", F.lit(True)), ["band", "key", "doc"], "left").withColumn("tried", F.expr("tried OR now IS NOT NULL")).drop("now")
        if got < PRODUCTIVE * met:
            break
    rows = cut(_open(rows, "top"), "rows")
    first = "NOT exists(zip_with(slice(x.keys, 1, band), slice(y.keys, 1, band), (p, q) -> p = q), same -> same)"
    pairs = rows.alias("x").join(rows.alias("y"), ["band", "key"]).filter(f"x.doc < y.doc AND {_may('top')} AND {first}").select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b"))
    new = found(cut(pairs, "more"))
    if new.head(1):
        return classes(new if links is None else links.union(new))
    return tops


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each class of ``docs``, classes linked by fingerprints within op9's 3 bits or by a
    Jaccard similarity of 0.8 or more.

    Rows are judged by their own texts, whatever ids they have. The row that stays has the least doc_id, a null one
    counting as the greatest, and then the least MD5 of its text; of rows equal in both any one
    stays. A null text is an empty one, and all empty ones are a class. Texts of under five words
    are linked by fingerprints alone. Empty tables give no rows; columns stay as they are.
    """
    own = "_node"
    marked = docs.withColumn(own, F.unhex(F.md5(F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8"))))
    rows = marked.select(F.col(own).alias("node"), "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    name = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    texts = cut(marked.groupBy(F.col(own).alias("node")).agg(F.min(name).alias("first"), F.count("*").alias("n")), "texts")
    roots = text_classes(rows, texts)
    best = texts.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("first", "node", "n")).alias("x"))
    best = cut(best.select(F.col("x.first.id").alias("_id"), F.col("x.node").alias("_own"), (F.col("x.n") > 1).alias("_again")), "kept")
    same = marked["doc_id"].eqNullSafe(best["_id"]) & (marked[own] == best["_own"])
    kept = marked.join(best, same).select(*docs.columns, own, "_again")
    # a text of several rows may stand in several rows of its least id
    return kept.filter("NOT _again").union(kept.filter("_again").dropDuplicates(["doc_id", own])).select(docs.columns)
