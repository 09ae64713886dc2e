import pytest
from pyspark.sql import functions as F

from nearsieve.functions import scalars
from nearsieve.operators import grams, metrics
from nearsieve.plans import catalogue
from nearsieve.sources import vectors


def test_libsvm_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("+1 1:0.5 3:2\n-1\n0 junk 2:1\n")
    rows = vectors.read_libsvm(spark, str(tmp_path / "a.txt")).orderBy("id").collect()
    assert [(r.id, r.label, r.indices, r.vals) for r in rows] == [(0, "+1", [1, 3], [0.5, 2.0]), (1, "-1", [], []), (2, "0", [2], [1.0])]
    assert [r.id for r in vectors.read_libsvm(spark, str(tmp_path / "a.txt"), 1, 1).collect()] == [1]


def test_partitioned_and_text_scans(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"part0{i}").write_text(f"{i} 1:1\n{i} 2:1\n")
    rows = vectors.read_partitioned(spark, str(tmp_path), "part", 10).collect()
    assert sorted((r.id, r.label, r.indices) for r in rows) == [(0, "0", [1]), (1, "0", [2]), (10, "1", [1]), (11, "1", [2])]
    (tmp_path / "t.txt").write_text("head:x\n7:some: text\nno colon\n8:\n")
    rows = vectors.read_texts(spark, str(tmp_path / "t.txt"), 1).collect()
    assert sorted((r.id, r.text) for r in rows) == [("7", ":some: text"), ("8", ":")]


def test_parts_hold_their_lines_by_id(spark, tmp_path):
    ids = [i * 7919 % 60_000 for i in range(6000)]
    long = spark.createDataFrame([(i, 1, 1.0) for i in ids], "id long, idx long, val double").repartition(5)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # several tasks give rows to each part
    try:
        vectors.write_partitioned(long, str(tmp_path), "part", 500)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    found = {r.id: r.label for r in vectors.read_partitioned(spark, str(tmp_path), "part", 500).collect()}
    wanted, last = {}, {}
    for i in sorted(ids):
        last[i // 500] = last.get(i // 500, -1) + 1
        wanted[i // 500 * 500 + last[i // 500]] = str(i)
    assert max(last) >= 100 and found == wanted


def test_round_trips(spark, tmp_path):
    long = spark.createDataFrame([(1, 2, 0.5), (1, 1, 1.0), (2, 9, 3.0)], "id long, idx long, val double")
    vectors.write_libsvm(long, f"{tmp_path}/v")
    back = vectors.to_long(vectors.read_libsvm(spark, f"{tmp_path}/v").withColumn("id", F.col("label").cast("long")))
    assert sorted(map(tuple, back.collect())) == [(1, 1, 1.0), (1, 2, 0.5), (2, 9, 3.0)]
    top = spark.createDataFrame([(q, r, 10 * q + r) for q in range(3) for r in range(2)], "qid long, rank int, id long")
    vectors.write_top_k(top, f"{tmp_path}/t")
    assert sorted(map(tuple, vectors.read_top_k(spark, f"{tmp_path}/t", 3, 2).collect())) == sorted(map(tuple, top.collect()))
    with pytest.raises(ValueError):
        vectors.read_top_k(spark, f"{tmp_path}/t", 4, 2)
    vectors.append_top_k(top, f"{tmp_path}/p")
    vectors.append_top_k(top, f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 12


def test_lines_are_numbered_by_path_whatever_is_read_first(spark, tmp_path):
    lines = []
    for i in range(10):  # files of growing size, the largest of which a scan reads first
        own = [f"{i} {j + 1}:1" + " 7:1" * i for j in range(20 * i + 1)]
        (tmp_path / f"f{i}").write_text("\n".join(own) + "\n")
        lines += own
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")  # several blocks a file
    try:
        rows = vectors.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.value for r in sorted(rows, key=lambda r: r.line_no)] == lines
    assert sorted(r.line_no for r in rows) == list(range(len(lines)))
    found = vectors.read_libsvm(spark, str(tmp_path), 30, 200).collect()
    assert {r.id: r.label for r in found} == {n: lines[n].split()[0] for n in range(30, 230)}
    top = spark.createDataFrame([(q, r, 10 * q + r) for q in range(80) for r in range(1 + q % 9)], "qid long, rank int, id long")
    vectors.write_top_k(top.repartition(7), f"{tmp_path}/t", 6)
    assert sorted(map(tuple, vectors.read_top_k(spark, f"{tmp_path}/t").collect())) == sorted(map(tuple, top.collect()))


def test_grams_equal_the_expression(spark):
    texts = [(1, "abcdef"), (2, None), (3, ""), (4, "abc"), (5, "é😀xyzabcdé" * 3), (6, "aaaaaaaaaa"), (1, "defghi"), (None, "xyzzy!"), (7, "".join(chr(0x4E00 + i * 7919 % 5000) for i in range(6000)))]
    rows = spark.createDataFrame(texts, "id long, text string")
    own = F.array_distinct(F.transform(scalars.char_ngrams(F.col("text"), 5), scalars.gram_hash))
    plain = {tuple(r) for r in rows.select("id", F.explode(own).alias("idx")).collect()}
    got = [tuple(r) for r in grams.features(rows).collect()]
    assert set(got) == plain
    sizes = {r.id: r.n for r in grams.set_sizes(rows).filter("n > 0").collect()}
    assert sizes == {i: sum(x[0] == i for x in plain) for i in {x[0] for x in plain}}
    least = {}
    for i, x in plain:
        least[i, x >> 11 & 1048575] = min(x, least.get((i, x >> 11 & 1048575), x))
    assert sorted(map(tuple, grams.bucket_minima(rows, 11, 20).collect()), key=str) == sorted(((*k, x) for k, x in least.items()), key=str)


def test_scalars(spark):
    rows = spark.createDataFrame([("abc",), ("abcdef",), (None,), ("é😀xyz",)], "t string").select(scalars.char_ngrams(F.col("t"), 5).alias("g")).collect()
    assert [r.g for r in rows] == [[], ["abcde", "bcdef"], [], ["é😀xyz"]]
    nums = spark.createDataFrame([(x,) for x in (-3, 0, 1, 2, 3, 8, 9)], "x long")
    assert [r.b for r in nums.select(scalars.bit_length(F.col("x")).alias("b")).collect()] == [0, 0, 0, 2, 2, 4, 4]
    assert [r.b for r in nums.select(scalars.next_power_of_two(F.col("x")).alias("b")).collect()] == [0, 1, 1, 2, 4, 8, 16]
    assert nums.select(scalars.pad_suffix(F.lit(7)).alias("p")).first().p == "07"
    pair = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>")
    assert [r.c for r in pair.select(scalars.dense_cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0.0, 1.0]


def test_quality_counts_missing_neighbours(spark):
    long = spark.createDataFrame([(0, 1, 1.0), (5, 1, 1.0), (6, 2, 1.0)], "id long, idx long, val double")
    results = spark.createDataFrame([(0, 0, 5), (0, 1, 6)], "qid long, rank int, id long")
    found = {r.k: r.similarity for r in metrics.similarity_at(results, long, 2, [1, 2, 4]).collect()}
    assert found == {1: 0.5, 2: 0.25, 4: 0.125}
    vectors_ = spark.createDataFrame([(1, 1, 1.0), (2, 1, 2.0), (3, 2, 1.0)], "id long, idx long, val double")
    assert abs(metrics.mean_pairwise_cosine(vectors_).first()[0] - 1 / 3) < 1e-12


def test_range_partition_is_balanced(spark):
    ids = spark.range(0, 11).select((F.col("id") * 700).alias("id"))
    parts = [r.part for r in catalogue.contiguous(ids, 4).orderBy("id").collect()]
    assert parts == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3]
