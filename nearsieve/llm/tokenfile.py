"""Token ids in files of fixed-width packed integers.

A file holds documents in ascending doc_id order. Ids are stored back to back
in ``bits`` bits each, the fewest that the vocabulary needs, least significant
bit first. Packing restarts at every block of BLOCK ids, so block b begins at a
byte that is known from b alone, and any run of ids is unpacked from the blocks
that it touches.

    magic "NSTK", version, bits, block (uint32 each)
    packed blocks
    doc_id (int64), first id (uint64) of each document, one more for the end
    byte offset of each block (uint64), one more for the end
    documents, ids, blocks, documents without an id (uint64 each), magic

Documents without an id are the last ones of a file; the table has -1 for them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearsieve.llm.env import open_fs, read_table, shared_dir, slices, write_whole
from nearsieve.llm.tokens import Encoder, encoder

MAGIC, VERSION, BLOCK = b"NSTK", 2, 1 << 14
END = 2


def width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(spread.reshape(-1), bitorder="little").tobytes()


def unpack(raw: bytes, count: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", count).astype(np.uint32)
    data = np.zeros(len(raw) + 8, np.uint8)
    data[: len(raw)] = np.frombuffer(raw, np.uint8)
    at = np.arange(count, dtype=np.uint64) * np.uint64(bits)
    byte, out = (at >> np.uint64(3)).astype(np.int64), np.zeros(count, np.uint64)
    for i in range(5):
        out |= data[byte + i].astype(np.uint64) << np.uint64(8 * i)
    return ((out >> (at & np.uint64(7))) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def file_chunks(docs: Iterable[tuple[int | None, np.ndarray]], bits: int, block: int = BLOCK) -> Iterator[bytes]:
    """The bytes of a file; only one block of ids and the document table are held."""
    yield MAGIC + struct.pack("<III", VERSION, bits, block)
    names, firsts, offsets, total, held, kept, at, nameless = [], [], [16], 0, [], 0, 16, 0
    for doc_id, ids in docs:
        if len(ids) and int(ids.max()) >> bits:
            raise ValueError(f"an id of document {doc_id} needs more than {bits} bits")
        names.append(-1 if doc_id is None else doc_id)
        nameless += doc_id is None
        firsts.append(total)
        total += len(ids)
        held.append(ids)
        kept += len(ids)
        if kept >= block:
            every = np.concatenate(held)
            for i in range(0, kept - block + 1, block):
                yield (raw := pack(every[i : i + block], bits))
                at += len(raw)
                offsets.append(at)
            held = [every[kept - kept % block :]]
            kept %= block
    if kept:
        yield (raw := pack(np.concatenate(held), bits))
        offsets.append(at + len(raw))
    yield np.array(names, "<i8").tobytes() + np.array([*firsts, total], "<u8").tobytes() + np.array(offsets, "<u8").tobytes()
    yield struct.pack("<QQQQ", len(names), total, len(offsets) - 1, nameless) + MAGIC


@dataclass
class TokenFile:
    """Random access to one file: ``ids(i)`` or ``span(first, end)``."""

    uri: str

    def __post_init__(self):
        system, path = open_fs(self.uri)
        self.source = system.open_input_file(path)
        size = self.source.size()
        head, tail = self.source.read_at(16, 0), self.source.read_at(36, size - 36)
        if head[:4] != MAGIC or tail[32:] != MAGIC:
            raise ValueError(f"{self.uri} is no token file")
        _, self.bits, self.block = struct.unpack("<III", head[4:])
        self.documents, self.total, blocks, self.nameless = struct.unpack("<QQQQ", tail[:32])
        length = 8 * (2 * self.documents + 1 + blocks + 1)
        table = self.source.read_at(length, size - 36 - length)
        self.doc_ids = np.frombuffer(table, "<i8", self.documents)
        self.firsts = np.frombuffer(table, "<u8", self.documents + 1, 8 * self.documents).astype(np.int64)
        self.offsets = np.frombuffer(table, "<u8", blocks + 1, 8 * (2 * self.documents + 1)).astype(np.int64)

    def span(self, first: int, end: int) -> np.ndarray:
        if first >= end:
            return np.zeros(0, np.uint32)
        low, high = first // self.block, (end - 1) // self.block
        raw = self.source.read_at(int(self.offsets[high + 1] - self.offsets[low]), int(self.offsets[low]))
        parts = []
        for b in range(low, high + 1):
            count = min(self.block, self.total - b * self.block)
            parts.append(unpack(raw[self.offsets[b] - self.offsets[low] : self.offsets[b + 1] - self.offsets[low]], count, self.bits))
        return np.concatenate(parts)[first - low * self.block : end - low * self.block]

    def ids(self, i: int) -> np.ndarray:
        return self.span(int(self.firsts[i]), int(self.firsts[i + 1]))


def encoded(batches: Iterable[pa.RecordBatch], own: Encoder, end: int | None) -> Iterator[tuple[int | None, np.ndarray]]:
    """``doc_id`` and ids of each row, ``end`` after them; texts are encoded 4 MB at once."""
    last = np.array([] if end is None else [end], np.uint32)
    for batch in slices(iter(batches), "text", 1 << 22):
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), own.many(batch.column("text")), strict=True):
            yield doc_id, np.append(ids, last)


MANIFEST = "file int, path string, documents long, ids long"


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, vocabulary: int, end: int | None = END, spaced: bool = False) -> DataFrame:
    """Write ``docs(doc_id, text)`` to files in ``folder``; returns their manifest.

    Documents are dealt out by ranges of doc_id, so files and the documents in
    them are in ascending order. Null texts are empty and hold the end id
    alone. Documents of one doc_id all stay, ordered by the text's digest and
    then its length. Rows with a null doc_id come after all others. An empty table gives no documents and no files. Other columns
    are ignored.
    """
    spark, bits = docs.sparkSession, width(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, own = TaskContext.get(), encoder(tokenizer, spaced)
        counts = [0, 0]

        def each(first: pa.RecordBatch):
            for doc_id, ids in encoded(chain([first], batches), own, end):
                counts[0] += 1
                counts[1] += len(ids)
                yield doc_id, ids

        for batch in batches:
            if batch.num_rows:
                path = f"{folder}/part-{task.partitionId():06d}.nstk"
                write_whole(path, file_chunks(each(batch), bits), str(task.taskAttemptId()))
                yield pa.record_batch([pa.array([task.partitionId()], pa.int32()), pa.array([path]), *(pa.array([n]) for n in counts)], ["file", "path", "documents", "ids"])

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc_nulls_last("doc_id"), F.xxhash64("text"), F.length("text")]
    rows = dealt.repartitionByRange(parts, order[0]).sortWithinPartitions(*order).mapInArrow(run, MANIFEST).collect()  # a row a file
    return spark.createDataFrame(sorted(rows), MANIFEST)


def read_tokens(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, unpacked from the files;
    start counts the ids of all documents before it."""
    rows, start, files = manifest.orderBy("file").collect(), 0, []
    for r in rows:
        files.append((r.path, start))
        start += r.ids
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                file = TokenFile(path)
                for low in range(0, file.documents, 256):
                    high = min(file.documents, low + 256)
                    marks = file.firsts[low : high + 1]
                    ids = file.span(int(marks[0]), int(marks[-1])).astype("<u4")
                    crcs = [zlib.crc32(ids[s - marks[0] : e - marks[0]].data) for s, e in zip(marks[:-1], marks[1:], strict=True)]
                    own = pa.array(file.doc_ids[low:high], mask=np.arange(low, high) >= file.documents - file.nameless)
                    yield pa.record_batch([own, pa.array(before + marks[:-1]), pa.array(np.diff(marks)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.createDataFrame(files, "path string, start long").repartition(len(files)).mapInArrow(run, schema)


def op2_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    manifest = write_tokens(docs, shared_dir(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"), 49_408)
    return read_tokens(spark, manifest)
