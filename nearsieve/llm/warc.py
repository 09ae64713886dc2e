"""WARC archives of pages, each record compressed alone with a dictionary.

The dictionary is built from records of the archive itself and stands in a
skippable Zstandard frame before the first record (magic 0x184D2A5D, as the
public WARC and Zstandard convention has it), so an archive is read without
any other file and any record from its offset alone. Pages whose payload
another page has become revisit records.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearsieve.llm.env import open_fs, read_table, shared_dir, slices, write_whole

MAGIC = 0x184D2A5D
DICTIONARY, SAMPLES = 48 << 10, 2 << 20  # bytes of a dictionary, and of the records it is built from
SMALL = 100  # smaller payloads are stored each time
_SPACE = uuid.UUID("6f3c2a52-1c63-5f0e-9d5b-0a4a3f1f8e11")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One uncompressed record. A revisit has no block; its headers keep the payload's length and digest."""
    block = payload if refers_to is None else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_SPACE, str(page_id) if page_id is not None else f'none {url} {digest}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join((url or 'about:blank').split())}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(_SPACE, str(refers_to))}>", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:size]


def build_dictionary(records: list[bytes], size: int = DICTIONARY) -> zstandard.ZstdCompressionDict:
    """Trained on the records; a few short ones are a plain dictionary themselves."""
    if len(records) >= 32:
        try:
            return zstandard.train_dictionary(size, records, k=512, d=8, level=3)
        except zstandard.ZstdError:
            pass
    return zstandard.ZstdCompressionDict(b"".join(records)[-size:] or b"\r\n\r\n\r\n\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive_chunks(records: Iterator[bytes], samples: int = SAMPLES) -> Iterator[bytes]:
    """The bytes of an archive: the dictionary's frame, then a frame a record.

    The dictionary is built from the first records, up to ``samples`` bytes
    (a bound on memory; every record is compressed and kept).
    """
    first, held = [], 0
    for r in records:
        first.append(r)
        held += len(r)
        if held >= samples:
            break
    book = build_dictionary([r[: 64 << 10] for r in first])
    raw = book.as_bytes()
    yield struct.pack("<II", MAGIC, len(raw)) + raw
    packer = zstandard.ZstdCompressor(level=3, dict_data=book, write_content_size=True)
    for r in first:
        yield packer.compress(r)
    for r in records:
        yield packer.compress(r)


def read_archive(uri: str) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """``(offset, headers, block)`` of every record, one frame in memory at a time."""
    system, path = open_fs(uri)
    with system.open_input_stream(path, compression=None) as source:
        magic, size = struct.unpack("<II", source.read(8))
        if magic != MAGIC:
            raise ValueError(f"{uri} has no dictionary frame")
        raw = source.read(size)
        trained = raw[:4] == b"\x37\xa4\x30\xec"
        book = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
        opener = zstandard.ZstdDecompressor(dict_data=book)
        at, rest = 8 + size, b""
        while True:
            rest = rest or source.read(1 << 20)
            if not rest:
                return
            frame, parts, used = opener.decompressobj(), [], 0
            while True:
                parts.append(frame.decompress(rest))
                if frame.eof:
                    used += len(rest) - len(frame.unused_data)
                    rest = frame.unused_data
                    break
                used += len(rest)
                rest = source.read(1 << 20)
                if not rest:
                    raise ValueError(f"{uri} ends within a record")
            yield (at, *parse(b"".join(parts)))
            at += used


def decide(pages: DataFrame, small: int = SMALL) -> DataFrame:
    """``page_id, url, payload, digest, refers_to``; refers_to is null for responses.

    The least page_id of each repeated payload is found by an aggregate that
    combines before its shuffle. Only that short list is joined, so a payload
    that a third of all pages have is no hot group.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    least = rows.filter(F.octet_length("payload") >= small).groupBy(F.col("digest").alias("own")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("own", "first")
    again = F.when((F.octet_length("payload") >= small) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(least, F.col("digest") == F.col("own"), "left").select("page_id", "url", "payload", "digest", again.alias("refers_to"))


MANIFEST = "path string, records long, bytes long"


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages(page_id, url, html)`` to archives in ``folder``; returns their manifest, a row an archive.

    A null html is an empty payload, a null url ``about:blank``. Rows of one
    page_id all get a record; those of equal payload are the response both. A
    page without page_id is a record without that header; it is never referred to, revisits a page of
    the same payload that has an id, and is a response where there is none. An empty table gives no
    archives. Other columns are ignored.
    """
    spark = pages.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get(), 0

        def records() -> Iterator[bytes]:
            nonlocal count
            for batch in slices(batches, "payload"):
                for row in batch.to_pylist():
                    count += 1
                    yield record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"])

        every = records()
        one = next(every, None)
        if one is not None:

            def all_of() -> Iterator[bytes]:
                yield one
                yield from every

            path = f"{folder}/pages-{task.partitionId():06d}.warc.zst"
            size = write_whole(path, archive_chunks(all_of()), str(task.taskAttemptId()))
            yield pa.record_batch([pa.array([path]), pa.array([count]), pa.array([size])], ["path", "records", "bytes"])

    return spark.createDataFrame(decide(pages).mapInArrow(run, MANIFEST).collect(), MANIFEST)  # a row an archive


SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """A row a record, from the archives. A response's digest and length are those of the
    payload that is read, and must be the ones in its headers."""
    paths = [(r.path,) for r in manifest.collect()]
    if not paths:
        return spark.createDataFrame([], SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                for _, head, block in read_archive(path):
                    size, digest = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha256:")
                    if head["WARC-Type"] == "response" and (len(block), hashlib.sha256(block).hexdigest()) != (size, digest):
                        raise ValueError(f"{path}: a payload is not the one that was written")
                    refers = head.get("X-Refers-To-Page-ID")
                    page = head.get("X-Page-ID")
                    rows.append((None if page is None else int(page), size, digest, head["WARC-Type"], None if refers is None else int(refers)))
                    if len(rows) >= 4096:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], TYPES)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], TYPES)

    return spark.createDataFrame(paths, "path string").repartition(len(paths)).mapInArrow(run, SCHEMA)


TYPES = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def op8_warc(spark, sf_dir: str) -> DataFrame:
    return read_archives(spark, write_archives(read_table(spark, sf_dir, "pages"), shared_dir(spark, "warc")))


OP8_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
