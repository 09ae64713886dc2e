"""Exact top-k search by inner product as a Voronoi kNN join.

Vectors get one more component, the root of a constant less their squared
length, so that the largest inner product with a query is the least Euclidean
distance to it. Pivots divide the space into cells. From each cell's summary
(its size and the k least distances of its rows to the pivot) every group of
queries, those of one cell, derives a distance within which its k results must
lie; the triangle inequality then says which rows of a cell could be that near,
and only those are sent to the group. Cells of queries that need much the same rows are
one group, as long as that sends fewer rows in all. Rows are dealt to blocks by their cells, and a group's
queries go to the blocks of cells that it needs. Each block is solved locally, and the k best of each are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearsieve.llm.env import cut, read_table

SCALE, TOP, EVERY = 256.0, 5, 50
PIVOTS, MOST_PIVOTS, SAMPLE = 48, 512, 4096  # pivots (a quarter of the root of the rows, within these), and the rows (by a hash of vec_id) among which they are chosen
QUERIES, ROWS = 4096, 16_384  # queries of a group, and rows of a block, that one task solves at a time
CELLS = 1 << 21  # scores that are worked out at a time


def quantized(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """``vec_id, v``: components floor(scale * x), whole numbers as doubles, which hold them exactly. Rows with a null
    id, a null vector, or a null or non-finite component are left out; a vector without components takes part."""
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter("vec_id IS NOT NULL AND x IS NOT NULL")
    ok = F.forall("x", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))  # a NaN is greater than any number
    whole = F.transform("x", lambda c: F.when(F.abs(c * scale) < 2.0**62, F.floor(c * scale).cast("double")).otherwise(c * scale))  # so large a double is whole
    return rows.filter(ok).select("vec_id", whole.alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros to ``width``."""
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    offsets = offsets - offsets[0]
    size = np.diff(offsets)
    if len(size) and (size == width).all():
        return flat.reshape(-1, width).astype(np.float64)
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(offsets[:-1], size)] = flat
    return out


def lifted(v: np.ndarray, longest: float) -> np.ndarray:
    """Data with its extra component; a query's is 0."""
    return np.hstack([v, np.sqrt(np.maximum(longest - (v * v).sum(axis=1), 0))[:, None]])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T, 0))


def spread_out(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots: a few rounds of k-means from evenly chosen rows of the sample."""
    centre = sample[np.linspace(0, len(sample) - 1, min(count, len(sample))).astype(int)]
    for _ in range(6):
        near = distances(sample, centre).argmin(axis=1)
        sums, n = np.zeros_like(centre), np.bincount(near, minlength=len(centre))
        np.add.at(sums, near, sample)
        centre = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centre)
    return np.unique(centre, axis=0)


def bounds(pivots: np.ndarray, query_radius: dict[int, float], nearest: dict[int, list[float]], k: int) -> dict[int, float]:
    """For each query cell, a distance that holds k rows of every query in it: the k-th least of
    radius + pivot distance + distance of a row to its own pivot."""
    between, out = distances(pivots, pivots), {}
    for cell, radius in query_radius.items():
        each = sorted(radius + between[cell, c] + d for c, ds in nearest.items() for d in ds)
        out[cell] = each[k - 1] if len(each) >= k else float("inf")
    return out


def scores(q: np.ndarray, x: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
    """Exact integer inner products, 0 where ``own`` says that a pair is none. Sums that could pass 2^53 are worked out in Python's integers; one that a
    long can't hold raises an OverflowError, as no score could be returned for it."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 2.0**53:
        return (q @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(c) for c in r] for r in m.tolist()], object).reshape(m.shape)
    found = whole(q) @ whole(x).T
    if own is not None:
        found[own] = 0
    return found.astype(np.int64)


def grouped(need: dict[int, set[int]], asks: dict[int, int], rows: dict[int, int], most: int) -> list[list[int]]:
    """Query cells put together, at most ``most`` queries in a group of several, wherever that sends fewer rows.

    ``need``: the data cells of each query cell; ``asks`` and ``rows``: queries and rows of cells.
    """
    sent = lambda cells: sum(rows[c] for c in cells)
    groups: list[tuple[list[int], set[int], int]] = []
    for a in sorted(need, key=lambda a: (-sent(need[a]), a)):
        gains = [(sent(cells) + sent(need[a]) - sent(cells | need[a]), -i) for i, (_, cells, n) in enumerate(groups) if n + asks[a] <= most]
        gain, at = max(gains, default=(0, 0))
        if gain > 0:
            members, cells, n = groups[-at]
            groups[-at] = ([*members, a], cells | need[a], n + asks[a])
        else:
            groups.append(([a], set(need[a]), asks[a]))
    return [g[0] for g in groups]


def dealt_blocks(rows: dict[int, int], most: int) -> dict[int, tuple[int, int]]:
    """First block and number of blocks of each cell; small neighbouring cells share one of at most ``most`` rows."""
    out, block, held = {}, 0, 0
    for c in sorted(rows):
        parts = -(-rows[c] // most)
        if held and (parts > 1 or held + rows[c] > most):
            block, held = block + 1, 0
        out[c] = (block, max(1, parts))
        held += rows[c]
        if parts > 1:
            block, held = block + parts, 0
    return out


def best(score: np.ndarray, qid: np.ndarray, vid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best columns of each row, ties to the least id; a query's own id is no candidate."""
    own = qid[:, None] == vid[None]
    floor = np.iinfo(np.int64).min + 1
    score = np.where(own, floor, score)
    if score.shape[1] > 4 * k:  # all columns that could be among the k best, ties included
        kth = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
        row, col = np.nonzero((score >= kth) & ~own)
    else:
        row, col = np.nonzero(~own)
    order = np.lexsort((vid[col], -score[row, col], row))
    row, col = row[order], col[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    keep = rank < k
    return row[keep], col[keep], score[row[keep], col[keep]]


RESULT = "query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, k: int = TOP, every: int = EVERY, pivots: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose vec_id is divisible by ``every``, the
    ``k`` other rows of highest inner product (all, if fewer), ties to the smaller vec_id.

    Vectors of different lengths are compared over zeros, so one without components scores 0 with all. Rows that
    ``quantized`` leaves out take no part. Rows that repeat a vec_id are
    candidates each, except to the query of that id, which is searched once
    for each of its different vectors (the least by value). An empty table
    gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = cut(quantized(vectors), "vectors")
    size = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    width, longest, count = rows.agg(F.max(F.size("v")), F.max(size), F.count("*")).first()
    pivots = pivots or min(MOST_PIVOTS, max(PIVOTS, int(count**0.5) // 4))
    if not count or not rows.filter(F.col("vec_id") % every == 0).head(1):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()  # SAMPLE rows
    if not np.isfinite(longest):
        raise OverflowError("a vector is too long for scores in a long")
    known = np.zeros((len(sample), width))
    for i, r in enumerate(sample):
        known[i, : len(r.v)] = r.v
    width = max(width, 1)
    known = np.pad(known, ((0, 0), (0, width - known.shape[1])))
    centre = spark.sparkContext.broadcast(spread_out(lifted(known, longest), pivots))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"), width)
            ids = batch.column("vec_id").to_numpy()
            data = distances(lifted(v, longest), centre.value)
            cell = data.argmin(axis=1)
            asks = distances(np.hstack([v, np.zeros((len(v), 1))]), centre.value)
            q = asks.argmin(axis=1)
            isq = ids % every == 0
            yield pa.record_batch(
                [batch.column("vec_id"), batch.column("v"), pa.array(cell.astype(np.int32)), pa.array(data[np.arange(len(v)), cell]), pa.array(np.where(isq, q, -1).astype(np.int32)), pa.array(np.where(isq, asks[np.arange(len(v)), q], 0.0))],
                ["vec_id", "v", "cell", "far", "ask", "ask_far"],
            )

    placed = cut(rows.mapInArrow(assign, "vec_id long, v array<double>, cell int, far double, ask int, ask_far double"), "cells")
    # summaries: a few numbers a cell
    # a query's own rows, as many as share its id, may be among the nearest; ids that repeat very often prune nothing
    need = k + (placed.groupBy("vec_id").count().agg(F.max("count")).first()[0])
    held = min(need, k + 64)
    part = F.pmod(F.xxhash64("vec_id"), F.lit(64))
    ranked = placed.select("cell", "far", part.alias("part")).withColumn("r", F.row_number().over(Window.partitionBy("cell", "part").orderBy("far"))).filter(F.col("r") <= held)
    near: dict[int, list[float]] = {}
    for r in ranked.groupBy("cell").agg(F.slice(F.array_sort(F.collect_list("far")), 1, held).alias("far")).collect():  # a row a cell
        near[r.cell] = r.far
    cells = {r.cell: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).collect()}  # a row a cell
    asking = {r.ask: (r.far, r.n) for r in placed.filter("ask >= 0").groupBy("ask").agg(F.max("ask_far").alias("far"), F.countDistinct("vec_id").alias("n")).collect()}
    reach = bounds(centre.value, {c: x[0] for c, x in asking.items()}, near, need)
    between = distances(centre.value, centre.value)
    slack = 1e-6 * (1 + np.sqrt(longest))
    # a row at distance far from its pivot can serve a cell of queries only if least <= far <= most
    window = {(a, c): (float(between[a, c] - asking[a][0] - reach[a] - slack), float(reach[a] + asking[a][0] + between[a, c] + slack)) for a in asking for c in cells}
    useful = {a: {c for c in cells if window[a, c][0] <= cells[c].high and window[a, c][1] >= cells[c].low} for a in asking}
    groups = grouped(useful, {a: n for a, (_, n) in asking.items()}, {c: r.n for c, r in cells.items()}, QUERIES)
    places = dealt_blocks({c: r.n for c, r in cells.items()}, ROWS)
    plan, sends = [], []
    for g, members in enumerate(groups):
        parts = -(-sum(asking[a][1] for a in members) // QUERIES)
        wanted = set().union(*(useful[a] for a in members))
        for c in wanted:
            own = [window[a, c] for a in members if c in useful[a]]
            plan.append((g, int(c), min(w[0] for w in own), max(w[1] for w in own), parts, *places[c]))
        blocks = sorted({b for c in wanted for b in range(places[c][0], places[c][0] + places[c][1])})
        sends += [(int(a), g, parts, blocks) for a in members]
    plan = F.broadcast(spark.createDataFrame(plan, "goes int, cell int, least double, most double, parts int, first int, several int"))  # at most pivots squared
    sends = spark.createDataFrame(sends, "ask int, goes int, parts int, blocks array<int>")
    # rows go to every group that they could serve; queries go to every block of their group
    block = F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), F.col("several")).cast("int")
    data = placed.join(plan, "cell").filter("far >= least AND far <= most").select(F.col("goes").alias("ask"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("sub"), block.alias("block"), F.lit(1).alias("kind"), "vec_id", "v")
    asks = placed.filter("ask >= 0").groupBy("vec_id").agg(F.min(F.struct("v", "ask")).alias("x")).select("vec_id", "x.v", "x.ask").join(sends, "ask")
    sub = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    asks = asks.select(F.col("goes").alias("ask"), sub.alias("sub"), F.explode("blocks").alias("block"), F.lit(0).alias("kind"), "vec_id", "v")
    dealt = asks.union(data).repartition("ask", "sub", "block").sortWithinPartitions("ask", "sub", "block", "kind")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, qid, q, found = None, None, None, None

        def settled():
            if found:
                a, b, s = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((b, -s, a))
                a, b, s = a[order], b[order], s[order]
                keep = np.arange(len(a)) - np.searchsorted(a, a) < k
                yield pa.record_batch([pa.array(a[keep]), pa.array(b[keep]), pa.array(s[keep])], ["query_id", "vec_id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in ("ask", "sub", "block")], axis=1)
            kind, ids, v = batch.column("kind").to_numpy(), batch.column("vec_id").to_numpy(), matrix(batch.column("v"), width)
            edge = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(key)]])
            for s, e in zip(edge[:-1], edge[1:], strict=True):
                if group != tuple(key[s]):
                    yield from settled()
                    group, qid, q, found = tuple(key[s]), np.zeros(0, np.int64), np.zeros((0, width)), []
                m = s + int(np.searchsorted(kind[s:e], 1))
                qid, q = np.concatenate([qid, ids[s:m]]), np.concatenate([q, v[s:m]])
                step = max(64, CELLS // max(1, len(qid)))
                for low in range(m, e, step):
                    if len(qid):
                        high = min(e, low + step)
                        row, col, score = best(scores(q, v[low:high], qid[:, None] == ids[None, low:high]), qid, ids[low:high], k)
                        found.append((qid[row], ids[low:high][col], score))
        yield from settled()

    solved = dealt.mapInArrow(solve, RESULT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return solved.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_voronoi_knn(spark, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
