"""SimHash near-duplicate classes by covering locality-sensitive hashing.

A family of bit masks is built from one 4-bit vector per fingerprint bit; mask
v keeps the bits whose vector has an odd inner product with v. The vectors of
three differing bits span at most three dimensions, so some v is orthogonal to
them all and its mask hides every difference: each pair within distance 3
collides in one of the 15 tables, without exception.
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

RADIUS = 3
SHINGLE = 3
BUCKET = 2048  # larger buckets go through a second family of masks; none is cut


def covering_masks(radius: int, seed: int, bits: int = 64) -> list[int]:
    """2^(radius+1) - 1 masks such that any two words of ``bits`` bits that differ in
    at most ``radius`` places agree under one of them."""
    ways = 2 ** (radius + 1) - 1
    vectors = [1 + i % ways for i in range(bits)]
    random.Random(seed).shuffle(vectors)
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, ways + 1)]


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash over XXH64 (seed 42) of all runs of ``k`` words; no words: 0."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = map(b" ".join, zip(*(words[j:] for j in range(k)), strict=False)) if len(words) >= k else [b" ".join(words)]
    h = np.array([xxh64_intdigest(x, 42) for x in runs], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE, name: str = "doc_id") -> DataFrame:
    """``(doc_id, fp)`` of whole texts, or another column than doc_id; fp is signed, as Spark's long. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = np.array([fingerprint(t, k) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(name), pa.array(fps)], [name, "fp"])

    kind = docs.schema[name].dataType.simpleString() if name != "doc_id" else "long"
    return docs.select(F.col(name).cast(kind).alias(name), F.col("text").cast("string").alias("text")).mapInArrow(run, f"{name} {kind}, fp long")


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that join the same classes as all pairs within ``radius`` do, at most one a value."""
    parent = np.arange(len(fps))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out, values = [], fps.view(np.uint64)
    for low in range(0, len(values), 512):
        rows = values[low : low + 512]
        for high in range(low, len(values), 4096):
            x, y = np.nonzero(np.bitwise_count(rows[:, None] ^ values[None, high : high + 4096]) <= radius)
            x, y = x + low, y + high
            keep = x < y
            for i, j in zip(x[keep].tolist(), y[keep].tolist(), strict=True):
                a, b = find(i), find(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out.append((int(fps[i]), int(fps[j])))
    return out


def _solve(radius: int, most: int | None):
    """Links of sorted buckets; values of buckets over ``most`` pass on, marked by a null b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held, over = ["t", "k", "u", "j"], [], False
        last = None

        def emit(rows, passed):
            a = [r[0] for r in rows] + passed
            b = [r[1] for r in rows] + [None] * len(passed)
            t, k = (last[0], last[1]) if last else (0, 0)
            n = len(a)
            return pa.record_batch([pa.array([t] * n, pa.int32()), pa.array([k] * n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["t", "k", "a", "b"])

        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in keys]
            fps = batch.column("fp").to_numpy()
            if not len(fps):
                continue
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            starts = np.concatenate([[0], new, [len(fps)]])
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                key = tuple(int(c[s]) for c in cols)
                if key != last:
                    if len(held) and sum(map(len, held)) > 1:
                        if rows := forest(np.concatenate(held), radius):
                            yield emit(rows, [])
                    held, over, last = [], False, key
                if over:
                    yield emit([], fps[s:e].tolist())
                    continue
                held.append(fps[s:e])
                if most and sum(map(len, held)) > most:
                    yield emit([], np.concatenate(held).tolist())
                    held, over = [], True
        if len(held) and sum(map(len, held)) > 1:
            if rows := forest(np.concatenate(held), radius):
                yield emit(rows, [])

    return run


def _tables(df: DataFrame, t: str, k: str, masks: list[int]) -> DataFrame:
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias(t), F.col("fp").bitwiseAND(F.lit(m)).alias(k)) for i, m in enumerate(signed)]))
    return df.select("*", each.alias("x")).select(*df.columns, f"x.{t}", f"x.{k}")


def links(values: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints of ``values(fp)`` whose classes are those
    of all pairs within ``radius``.

    Buckets of one mask hold distinct values only. One over BUCKET values is
    split again by a second family, which keeps every pair for the same
    reason; there some 48 bits agree, so a bucket has a fixed largest size and
    is solved in blocks.
    """
    one = _tables(values.select("fp"), "t", "k", covering_masks(radius, 9)).withColumns({"u": F.lit(0), "j": F.lit(0).cast("long")})
    schema = "t int, k long, a long, b long"
    keys = ["t", "k", "u", "j"]
    first = cut(one.repartition("t", "k").sortWithinPartitions(*keys, "fp").mapInArrow(_solve(radius, BUCKET), schema), "links")
    edges = first.filter("b IS NOT NULL").select("a", "b")
    large = first.filter("b IS NULL")
    if large.head(1):
        two = _tables(large.select("t", "k", F.col("a").alias("fp")), "u", "j", covering_masks(radius, 77))
        edges = edges.union(two.repartition(*keys).sortWithinPartitions(*keys, "fp").mapInArrow(_solve(radius, None), schema).select("a", "b"))
    return edges


def near_classes(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row a document: ``doc_id, fp, component_id``.

    component_id is the least doc_id reachable over links of fingerprints that
    differ in at most ``radius`` bits. Documents without words have fingerprint
    0 and link like any other; equal fingerprints are one node, so copies cost
    no pairs. A null doc_id stays a row and is never chosen as component_id
    (null only if its class has no other id). Repeated doc_ids stay repeated
    rows; an empty table gives none; columns but doc_id and text are ignored.
    """
    prints = cut(fingerprints(docs), "prints")
    values = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "values")
    roots = components(links(values, radius))
    rooted = values.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    from nearsieve.llm.env import read_table

    found = near_classes(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
