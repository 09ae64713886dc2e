"""Benchmark decontamination: which documents contain which test items.

An item is contained when at least THRESHOLD of its distinct runs of five words
occur in the document (letters and digits, case folded, punctuation ignored).

Search by MinHash, in classes of item size. A contained item of n shingles
misses at most n - ceil(0.8 n) of them, so among its m = n - ceil(0.8 n) + 1
smallest hashes one at least is in the document: a class's sketch length
follows from its sizes, and no contained item goes unseen, however long the
document. On the other side a document's sketch is its hashes up to the largest
sketch hash of the classes that are small enough to fit in it. Candidates are
then verified on the words themselves.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearsieve.llm.env import read_table, slices
from nearsieve.llm.words import Words

SHINGLE, THRESHOLD = 5, 0.8
BLOCK_BYTES = 16 << 20  # text of items that is searched in one pass over the documents
_BITS = 22


def _needed(n: int, threshold: float) -> int:
    return math.ceil(threshold * n - 1e-9)


class Items:
    """Sketches of a block of items by size class, and their shingles for verification."""

    def __init__(self, ids: list[int], texts: list[str], k: int, threshold: float):
        self.k, self.threshold = k, threshold
        words = Words(pa.array(texts, pa.string()))
        hashes, at = words.shingles(k)
        self.ids, self.shingles = ids, []
        classes: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for i in range(len(ids)):
            own = [words.text(w) for w in range(words.first[i], words.first[i + 1])]
            self.shingles.append(frozenset(zip(*(own[j:] for j in range(k)), strict=False)))
            distinct = np.unique(hashes[words.row[at] == i])
            if len(distinct):
                n = len(distinct)
                classes[n.bit_length()].append((distinct[: n - _needed(n, threshold) + 1], i))
        #: for each class: fewest shingles a document must have, sorted hashes, their items
        self.classes = []
        for size, members in sorted(classes.items()):
            h = np.concatenate([m[0] for m in members])
            who = np.repeat([m[1] for m in members], [len(m[0]) for m in members])
            order = np.argsort(h, kind="stable")
            self.classes.append((_needed(1 << (size - 1), threshold), h[order], who[order]))
        self.seen = np.zeros(1 << _BITS, bool)
        for _, h, _ in self.classes:
            self.seen[h & np.uint64((1 << _BITS) - 1)] = True

    def candidates(self, words: Words) -> list[tuple[int, int]]:
        """(row, item) of all texts and items that share a sketch hash."""
        h, at = words.shingles(self.k)
        sketch = np.flatnonzero(self.seen[h & np.uint64((1 << _BITS) - 1)])
        h, row = h[sketch], words.row[at[sketch]]
        size = np.maximum(np.diff(words.first) - self.k + 1, 0)[row]
        found = set()
        for least, hashes, who in self.classes:
            fits = (size >= least) & (h <= hashes[-1])  # the document's sketch for this class
            hit, r = h[fits], row[fits]
            low, high = np.searchsorted(hashes, hit, "left"), np.searchsorted(hashes, hit, "right")
            for i in np.flatnonzero(high > low):
                found.update((int(r[i]), int(x)) for x in who[low[i] : high[i]])
        return sorted(found)

    def verify(self, words: Words, pairs: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        """(row, item, shingles of the item in the text, shingles of the item) of the pairs that hold."""
        out, last, have = [], None, frozenset()
        for row, item in pairs:
            if row != last:
                own = [words.text(w) for w in range(words.first[row], words.first[row + 1])]
                have, last = frozenset(zip(*(own[j:] for j in range(self.k)), strict=False)), row
            want = self.shingles[item]
            n = len(want & have)
            if want and n >= _needed(len(want), self.threshold):
                out.append((row, item, n, len(want)))
        return out


SCHEMA = "doc_id long, item_id long, n_found long, n_shingles long"


def contained_items(docs: DataFrame, items: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, item_id, n_found, n_shingles`` of every item contained in every document.

    ``items(item_id, text)`` are searched in blocks of at most BLOCK_BYTES of
    text (one block for any common benchmark); each block is one pass over the
    documents, without a shuffle. Items of fewer than ``k`` words would match
    ordinary prose and are contained in nothing, as are null texts. Repeated
    items and documents give a row each. A null doc_id or item_id is kept.
    Empty tables give no rows; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for shared in blocks(items, k, threshold):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in slices(batches, "text"):
                words = Words(batch.column("text"))
                found = own.verify(words, own.candidates(words))
                names = batch.column("doc_id").to_pylist()
                cols = [[names[r] for r, *_ in found], [own.ids[i] for _, i, *_ in found], [x[2] for x in found], [x[3] for x in found]]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], [c.split()[0] for c in SCHEMA.split(", ")])

        part = docs.mapInArrow(run, SCHEMA)
        out = part if out is None else out.union(part)
    return out


def blocks(items: DataFrame, k: int, threshold: float) -> Iterator[Broadcast]:
    """``Items`` of at most about BLOCK_BYTES of text each, one at least."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).cast("long")).first()[0]
    count = max(1, -(-total // BLOCK_BYTES))
    for b in range(count):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == b).collect()  # at most about BLOCK_BYTES
        yield items.sparkSession.sparkContext.broadcast(Items([r[0] for r in rows], [r[1] or "" for r in rows], k, threshold))


def drop_contaminated(docs: DataFrame, items: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose own text contains no item, whatever their ids; a filter within the scan.

    Columns stay as they are; null and empty texts contain nothing.
    """
    for shared in blocks(items, k, threshold):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in slices(batches, "text"):
                words = Words(batch.column("text").cast(pa.string()))
                hit = [r for r, *_ in own.verify(words, own.candidates(words))]
                clean = np.ones(batch.num_rows, bool)
                clean[hit] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = contained_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.withColumn("containment", F.round(F.col("n_found") / F.col("n_shingles"), 6))
