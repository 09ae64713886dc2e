import hashlib
import io
import struct

import zstandard

from nearsieve.llm import warc
from nearsieve.llm.env import shared_dir


def plain(rows):
    first = {}
    for i, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= 100 and i is not None:
            first[raw] = min(i, first.get(raw, i))
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        again = raw in first and first[raw] != i
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[raw] if again else None))
    return sorted(out, key=str)


def test_archives_round_trip(spark):
    page = "<html>" + "é<p>some page</p>" * 30
    rows = [(9, "http://a.example/", page), (4, None, page), (5, "x\r\ny", page), (4, "again", page), (1, "", None), (2, "u", ""), (3, "s", "tiny"), (6, "s", "tiny"), (7, "big", "word " * 400_000), (8, "edge", "a" * 99), (10, "edge", "a" * 99), (11, "e", "b" * 100), (12, "e", "b" * 100)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, first int")
    manifest = warc.write_archives(table.repartition(2), shared_dir(spark, "w"))
    assert sum(r.records for r in manifest.collect()) == len(rows)
    assert sorted((tuple(r) for r in warc.read_archives(spark, manifest).collect()), key=str) == plain(rows)
    none = warc.write_archives(table.limit(0), shared_dir(spark, "w"))
    assert warc.read_archives(spark, none).count() == 0
    rows += [(None, "u", "h"), (None, "v", page), (None, None, "z" * 200), (None, None, "z" * 200)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = warc.read_archives(spark, warc.write_archives(table.repartition(2), shared_dir(spark, "w"))).collect()
    assert sorted(map(tuple, found), key=str) == plain(rows)


def test_dictionary_comes_first_and_records_stand_alone(tmp_path):
    records = [warc.record(i, f"http://e.example/{i}", f"<html><body>page number {i} ".encode() + b"common words here " * 9, "00", None) for i in range(200)]
    raw = b"".join(warc.archive_chunks(iter(records)))
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == 0x184D2A5D and raw[8:12] == b"\x37\xa4\x30\xec"
    (tmp_path / "a.warc.zst").write_bytes(raw)
    offsets = [at for at, _, _ in warc.read_archive(str(tmp_path / "a.warc.zst"))]
    assert len(offsets) == 200 and offsets[0] == 8 + size
    book = zstandard.ZstdCompressionDict(raw[8 : 8 + size])
    one = zstandard.ZstdDecompressor(dict_data=book).stream_reader(io.BytesIO(raw[offsets[150] :])).read(1 << 16)
    assert one.startswith(records[150])
    alone = sum(len(zstandard.compress(r)) for r in records)
    assert len(raw) - size - 8 < alone / 2
    assert list(warc.read_archive(_written(tmp_path, records[:1])))[0][2] == warc.parse(records[0])[1]


def _written(folder, records):
    (folder / "one.warc.zst").write_bytes(b"".join(warc.archive_chunks(iter(records))))
    return str(folder / "one.warc.zst")
