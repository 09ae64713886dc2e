"""Documents packed into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearsieve.llm.env import read_table, slices
from nearsieve.llm.tokens import encoder

WINDOW = 1024
PIECE = 200  # the remainder of a document is cut to at most this
BLOCK = 16  # windows packed at a time
SLACK = 2  # ids that a packed window leaves free, so that differencing seldom exceeds it


def differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """Indices of ``sizes`` in ``ways`` parts of nearly equal sums.

    A state is a tuple of part sums, largest first, less its least sum. The
    two states with the widest spread are merged, the largest part of one with
    the smallest of the other, until one is left. Parts are linked lists, so
    a merge moves no members.
    """
    if not sizes:
        return [[] for _ in range(ways)]
    heap = []
    for i, n in enumerate(sizes):
        heap.append((-n, i, [(n, (i, None, None))] + [(0, None)] * (ways - 1)))
    heapq.heapify(heap)
    order = len(sizes)
    while len(heap) > 1:
        _, _, one = heapq.heappop(heap)
        _, _, two = heapq.heappop(heap)
        joined = [(a + b, x if y is None else y if x is None else (None, x, y)) for (a, x), (b, y) in zip(one, reversed(two), strict=True)]
        joined.sort(key=lambda p: -p[0])
        least = joined[-1][0]
        joined = [(s - least, x) for s, x in joined]
        heapq.heappush(heap, (-joined[0][0], order, joined))
        order += 1
    parts = []
    for _, tree in heap[0][2]:
        members, todo = [], [tree] if tree else []
        while todo:
            i, x, y = todo.pop()
            if i is None:
                todo += [y, x]
            else:
                members.append(i)
        parts.append(members)
    return parts


def windows(sizes: list[int], window: int) -> list[list[int]]:
    """``differencing`` into the fewest windows that differencing fits, none over ``window``."""
    ways = max(1, -(-sum(sizes) // window))
    while True:
        parts = differencing(sizes, ways)
        if max(sum(sizes[i] for i in p) for p in parts) <= window:
            return [p for p in parts if p]
        ways += 1


def cuts(length: int, window: int, piece: int) -> tuple[list[int], list[int]]:
    """Lengths of a document's full windows, and of the pieces of its remainder.

    Pieces have all lengths from 1 to ``piece``, drawn by a generator seeded
    with the length: differencing balances mixed sizes to within a token or two.
    """
    full, rest = divmod(length, window)
    sizes, draw = [], random.Random(length)
    while rest:
        sizes.append(min(rest, draw.randint(1, piece)))
        rest -= sizes[-1]
    return [window] * full, sizes


def powers(total: int) -> list[int]:
    """Powers of two with the sum ``total``, largest first."""
    return [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = 0, spaced: bool = True) -> DataFrame:
    """One row a piece of ``docs(doc_id, text)``: ids of the text, then ``end``, cut into pieces that fill windows.

    Full windows of a long document stand alone. What remains of documents is
    cut to short pieces; each task gathers the pieces of BLOCK windows and
    divides them by differencing, so nothing is shuffled and a task holds one
    block. What fills no window at a task's end is cut into powers of two,
    which need no padding. sequence_id is the
    task's number above 2^40 and a counter below, the same whenever a lost
    task runs again over the same rows.

    Null texts are empty and hold the end id alone; rows with a null doc_id
    are packed with a null doc_id; repeated rows are packed each; an empty
    table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, base = encoder(tokenizer, spaced), TaskContext.get().partitionId() << 40
        count, rows = 0, []
        held: list[tuple] = []  # doc_id, start, ids, ids of the whole document
        waiting = 0

        def place(members: list[tuple]) -> None:
            nonlocal count
            at = 0
            for doc_id, start, ids, total in members:
                rows.append((doc_id, start, len(ids), zlib.crc32(ids), total, base + count, at))
                at += len(ids)
            count += 1

        def take(total: int) -> list[tuple]:
            """The first ``total`` ids held; the piece at the border is cut."""
            nonlocal held, waiting
            taken, got, i = [], 0, 0
            waiting -= total
            while got < total:
                doc_id, start, ids, whole = held[i]
                if got + len(ids) > total:
                    n = total - got
                    held[i] = (doc_id, start + n, ids[n:], whole)
                    ids = ids[:n]
                else:
                    i += 1
                taken.append((doc_id, start, ids, whole))
                got += len(ids)
            held = held[i:]
            return taken

        def settle(n: int) -> None:
            pieces = take(n * (window - SLACK))
            for part in windows([len(p[2]) for p in pieces], window):
                place([pieces[i] for i in part])

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            rows.clear()
            return pa.record_batch([pa.array(c, pa.int64()) for c in cols], [c.split()[0] for c in SCHEMA.split(", ")])

        for batch in slices(batches, "text", 1 << 22):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), own.many(batch.column("text")), strict=True):
                ids = np.append(ids, np.uint32(end))
                full, rest = cuts(len(ids), window, PIECE)
                at = 0
                for n in full:
                    place([(doc_id, at, ids[at : at + n], len(ids))])
                    at += n
                for n in rest:
                    held.append((doc_id, at, ids[at : at + n], len(ids)))
                    at += n
                    waiting += n
                while waiting >= BLOCK * (window - SLACK):
                    settle(BLOCK)
            if rows:
                yield out()
        if waiting >= window - SLACK:
            settle(waiting // (window - SLACK))
        for n in powers(waiting):
            place(take(n))
        if rows:
            yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
