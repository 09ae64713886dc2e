"""Character n-grams of whole texts as sets of hashed indices.

Expressions would hash every gram of every text; here the grams of some megabytes
of text become integers, and each different one is hashed once. That is the
only place in the core where Python runs on executors, batch by batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE = 4 << 20  # bytes of text that are worked on at a time
WHOLE = 1 << 32


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds about ``limit`` bytes in each, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, begin = np.cumsum(sizes), 0
        while begin < len(sizes):
            before = int(ends[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def gram_keys(codes: np.ndarray, n: int, spare: int) -> tuple[np.ndarray, np.ndarray, int | None]:
    """An integer for each run of ``n`` codes, equal for equal runs alone, that leaves ``spare`` bits of 63 free.

    Also the alphabet and, where a key is the places of its codes in the alphabet, the bits of one.
    """
    mark = np.zeros(int(codes.max(initial=0)) + 1, bool)
    mark[codes] = True
    alphabet = np.flatnonzero(mark)
    small, width = (np.cumsum(mark) - 1)[codes], max(1, (len(alphabet) - 1).bit_length())
    m = len(codes) - n + 1
    key, used, plain = small[:m].copy(), width, True
    for j in range(1, n):
        if used + width > 63:
            values, key = np.unique(key, return_inverse=True)
            used, plain = max(1, (len(values) - 1).bit_length()), False
        key <<= width
        key |= small[j : m + j]
        used += width
    if used + spare > 63:
        key, plain = np.unique(key, return_inverse=True)[1], False
    return key, alphabet, width if plain else None


def hashed_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct indices of the grams of each text, and where each text's begin (one more entry for the end).

    An index is the first 32 bits of a gram's MD5, modulo 2^32 - 1, plus 1.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = memoryview(texts.buffers()[2] or b"")[int(offsets[0]) : int(offsets[-1])]
    codes = np.frombuffer(str(raw, "utf-8").encode("utf-32-le"), "<u4")
    heads = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # the first byte of each code point
    row = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(np.searchsorted(heads, offsets - offsets[0])))
    m, bits = len(codes) - n + 1, max(1, (len(texts) - 1).bit_length())
    if m < 1:
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    whole = row[:m] == row[n - 1 :]
    key, alphabet, width = gram_keys(codes, n, bits)
    # one sort of grams and rows packed together gives the distinct grams of each row
    pair = np.sort((key << bits | row[:m])[whole])
    pair = pair[np.concatenate([[True], pair[1:] != pair[:-1]])] if len(pair) else pair
    key_of, row_of = pair >> bits, pair & (1 << bits) - 1
    new = np.concatenate([[True], key_of[1:] != key_of[:-1]]) if len(pair) else np.zeros(0, bool)
    md5, distinct = hashlib.md5, key_of[new]
    if width is None:
        at = np.flatnonzero(whole)
        values, first = np.unique(key[at], return_index=True)
        begin, end = heads[at[first]], np.append(heads, len(raw))[at[first] + n]
        digests = [md5(raw[s:e]).digest()[:4] for s, e in zip(begin.tolist(), end.tolist(), strict=True)]
    else:
        places = np.stack([distinct >> width * (n - 1 - j) & (1 << width) - 1 for j in range(n)], axis=1)
        text = alphabet[places].astype("<u4").tobytes().decode("utf-32-le")
        digests = [md5(text[i : i + n].encode()).digest()[:4] for i in range(0, len(text), n)]
    index = np.frombuffer(b"".join(digests), ">u4").astype(np.int64) % (WHOLE - 1) + 1
    values, rank = np.unique(index, return_inverse=True)
    own = np.sort(row_of * len(values) + rank[np.cumsum(new) - 1])
    own = own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own
    row_of = own // max(1, len(values))
    return values[own - row_of * len(values)], np.concatenate([[0], np.cumsum(np.bincount(row_of, minlength=len(texts)))])


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt to all cores where the table has fewer files than there are cores: one
    file of one row group is one task. Larger tables are read as they lie, without a shuffle."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores * 2) if len(rows.inputFiles()) < cores else rows


def gram_sets(rows: DataFrame, n: int = 5) -> DataFrame:
    """``id, grams``: the set of each row of ``rows(id, text)`` as an ascending array; no shuffle but ``spread``.

    Null and short texts have empty sets. Rows that repeat an id keep a set each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values, starts = hashed_sets(batch.column("text"), n)
            yield pa.record_batch([batch.column("id"), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values))], ["id", "grams"])

    return spread(rows.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))).mapInArrow(run, "id long, grams array<long>")


def apart(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` of ids that occur once, and those of ids that occur again (None if there are none, the usual case).

    Only the latter need a shuffle to be combined. Null ids are combined, too.
    """
    again = rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("id").alias("again"))
    if not again.limit(1).collect():
        return rows, None
    same = rows["id"].eqNullSafe(again["again"])
    return rows.join(again, same, "left_anti"), rows.join(again, same, "left_semi")


def features(rows: DataFrame, n: int = 5) -> DataFrame:
    """``id, idx``: the features of each row of ``rows(id, text)``, for operators to which repeated features mean nothing."""
    return gram_sets(rows, n).select("id", F.explode("grams").alias("idx"))


def set_sizes(rows: DataFrame, n: int = 5) -> DataFrame:
    """``id, n``: how many distinct features each id has; texts of one id are one set."""
    single, again = apart(rows)
    sizes = gram_sets(single, n).select("id", F.size("grams").cast("long").alias("n"))
    return sizes if again is None else sizes.union(features(again, n).groupBy("id").agg(F.countDistinct("idx").alias("n")))


def bucket_minima(rows: DataFrame, low: int, bits: int, n: int = 5) -> DataFrame:
    """``id, bucket, h``: the least index in each bucket, which is ``bits`` bits of it above the ``low`` lowest."""
    bucket = lambda x: F.shiftright(x, low).bitwiseAND(F.lit((1 << bits) - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = batch.column("grams")
            values, starts = sets.flatten().to_numpy(zero_copy_only=False), sets.offsets.to_numpy()
            starts = starts - starts[0]
            row = np.repeat(np.arange(len(sets)), np.diff(starts))
            own = row << bits | (values >> low & (1 << bits) - 1)
            order = np.argsort(own, kind="stable")  # indices ascend in each row, so the first of a bucket is its least
            keep = np.ones(len(own), bool)
            keep[1:] = own[order[1:]] != own[order[:-1]]
            values, row = values[order[keep]], row[order[keep]]
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(sets)))])
            yield pa.record_batch([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))], ["id", "grams"])

    def least(part: DataFrame) -> DataFrame:
        return gram_sets(part, n).mapInArrow(run, "id long, grams array<long>").select("id", F.explode("grams").alias("h")).select("id", bucket(F.col("h")).alias("bucket"), "h")

    single, again = apart(rows)
    return least(single) if again is None else least(single).union(least(again).groupBy("id", "bucket").agg(F.min("h").alias("h")))
