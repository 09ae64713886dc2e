"""Readers and writers of sparse vectors, texts and results.

Vectors travel in long form ``(id, idx, val)``; indices are at least 1.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearsieve.functions.scalars import pad_suffix


BLOCKS = 100_000  # lists of file blocks of up to this many rows, of some 200 bytes, are broadcast


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, file, line, value`` of text files: ``line_no`` counts all lines, by path and then by place in
    the file, ``line`` those of the file.

    Lines are counted once for each block of a file and the counts summed by (path, start of the block), whatever order
    the scan reads blocks in; nothing sorts lines.
    """
    lines = spark.read.text(path)
    few = len(lines.inputFiles()) + 2 * lines.rdd.getNumPartitions() <= BLOCKS  # so many blocks at most
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    blocks = lines.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    files = blocks.groupBy("file").agg(F.sum("n").alias("n"))
    whole = files.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a file
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.withColumn("inner", inner).join(whole, "file").select("file", "start", "first", "inner", "before")
    found = lines.join(F.broadcast(starts) if few else starts, ["file", "start"])
    line = F.col("at") - F.col("first") + F.col("inner")
    return found.select((line + F.col("before")).alias("line_no"), "file", line.alias("line"), "value")


def parse_libsvm(lines: DataFrame, id_column: str = "line_no", value: str = "value") -> DataFrame:
    """``id, label, indices, vals`` of lines ``label idx:val ...``.

    The first token is the label; tokens without a colon are skipped; a line
    without features is an empty vector.
    """
    tokens = F.filter(F.split(F.trim(value), r"\s+"), lambda t: t != "")
    pairs = F.filter(F.slice(tokens, 2, 1 << 30), lambda t: F.instr(t, ":") > 0)
    return lines.select(
        F.col(id_column).alias("id"),
        F.get(tokens, F.lit(0)).alias("label"),
        F.transform(pairs, lambda t: F.substring_index(t, ":", 1).cast("long")).alias("indices"),
        F.transform(pairs, lambda t: F.substring_index(t, ":", -1).cast("double")).alias("vals"),
    )


def parse_keyed(lines: DataFrame, value: str = "value") -> DataFrame:
    """``id, label, indices, vals`` of lines ``key label idx:val ...``."""
    key = F.substring_index(F.trim(value), " ", 1)
    rest = F.substring(F.trim(value), F.length(key) + 2, F.length(value))
    return parse_libsvm(lines.select(key.cast("long").alias("key"), rest.alias("rest")), "key", "rest")


def read_libsvm(spark: SparkSession, path: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Vectors of lines [offset, offset + limit); ids are line numbers."""
    lines = numbered_lines(spark, path).filter(F.col("line_no") >= offset)
    return parse_libsvm(lines if limit is None else lines.filter(F.col("line_no") < offset + limit))


def read_partitioned(spark: SparkSession, folder: str, base: str, per_file: int) -> DataFrame:
    """Parts ``base00, base01, ...`` of a folder, files or folders of files in order: ids are part number *
    per_file + line in the part."""
    lines = numbered_lines(spark, f"{folder}/*{base}*")
    lines = lines.withColumn("part", F.regexp_extract("file", f"(?:/|=){base}([0-9]+)(?:/[^/]*)?$", 1).cast("long"))
    least = lines.groupBy("part").agg(F.min("line_no").alias("least"))  # a row a part
    numbered = lines.join(F.broadcast(least), "part")
    return parse_libsvm(numbered.select("value", (F.col("part") * per_file + F.col("line_no") - F.col("least")).alias("line_no")))


def write_partitioned(long: DataFrame, folder: str, base: str, per_file: int) -> None:
    """Lines of ids [k * per_file, (k + 1) * per_file) go to part ``base`` k, by ascending id; overwrites.

    A writer of parts wants rows by part, and sorts them anew, which drops every other order, unless it sees that
    they come so: they are sorted by part and id, and a name is never null (an empty one is Spark's default part).
    """
    name = F.coalesce(file_name(F.expr(f"id div {per_file}"), base), F.lit(""))
    lines = libsvm_lines(long).withColumn("file", name).repartitionByRange("id").sortWithinPartitions("file", "id")
    lines.select("file", "line").write.mode("overwrite").partitionBy("file").text(folder)


def batches(vectors: DataFrame, size: int) -> DataFrame:
    """The scan as a resumable one: batch k holds ids [k * size, (k + 1) * size)."""
    return vectors.withColumn("batch", F.floor(F.col("id") / size).cast("long"))


def read_texts(spark: SparkSession, path: str, offset: int = 0) -> DataFrame:
    """``id, text`` of lines ``id:text``; lines without a colon and the first ``offset`` are skipped.
    The text keeps its leading colon."""
    lines = numbered_lines(spark, path).filter((F.col("line_no") >= offset) & F.col("value").contains(":"))
    key = F.substring_index("value", ":", 1)
    return lines.select(key.alias("id"), F.substring(F.col("value"), F.length(key) + 1, F.length("value")).alias("text"))


def to_long(vectors: DataFrame) -> DataFrame:
    return vectors.select("id", F.explode(F.arrays_zip("indices", "vals")).alias("x")).select("id", F.col("x.indices").alias("idx"), F.col("x.vals").alias("val"))


def libsvm_lines(long: DataFrame, label: Column | None = None) -> DataFrame:
    """``id, line``: features of each vector by index."""
    pairs = F.array_sort(F.collect_list(F.struct("idx", F.col("val").cast("double").alias("val"))))
    own = long.groupBy("id").agg(pairs.alias("p"))
    line = F.concat_ws(" ", (label if label is not None else F.col("id")).cast("string"), F.transform("p", lambda p: F.concat(p["idx"].cast("string"), F.lit(":"), F.format_string("%.6f", p["val"]))))
    return own.select("id", line.alias("line"))


def write_libsvm(long: DataFrame, path: str, per_file: int = 0) -> None:
    """A line a vector, by ascending id, at most ``per_file`` in a file if that is not 0; overwrites."""
    libsvm_lines(long).orderBy("id").select("line").write.mode("overwrite").option("maxRecordsPerFile", per_file).text(path)


def write_texts(texts: DataFrame, path: str, per_file: int = 0) -> None:
    """Lines ``id:text`` of ``texts(id, text)`` by ascending id; line ends in a text become spaces; nulls are left out; overwrites."""
    line = F.concat(F.col("id").cast("string"), F.lit(":"), F.translate("text", "\n\r", "  "))
    texts.filter("text IS NOT NULL").orderBy("id").select(line.alias("line")).write.mode("overwrite").option("maxRecordsPerFile", per_file).text(path)


def write_top_k(results: DataFrame, path: str, per_file: int = 0) -> None:
    """A line a query by ascending qid, its ids by rank; overwrites."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "id")))
    line = F.concat_ws(" ", F.transform("r", lambda r: r["id"].cast("string")))
    results.groupBy("qid").agg(ranked.alias("r")).select("qid", line.alias("line")).orderBy("qid").select("line").write.mode("overwrite").option("maxRecordsPerFile", per_file).text(path)


def append_top_k(results: DataFrame, path: str) -> None:
    results.write.mode("append").parquet(path)


def read_top_k(spark: SparkSession, path: str, queries: int | None = None, k: int | None = None) -> DataFrame:
    """``qid, rank, id``; qid is the line's number in the order of ``numbered_lines``, in which ``write_top_k``
    writes. ``queries`` and ``k``, if given, must fit the files."""
    rows = numbered_lines(spark, path).select(F.col("line_no").alias("qid"), F.posexplode(F.split(F.trim("value"), " ")).alias("rank", "id")).withColumn("id", F.col("id").cast("long"))
    if queries is not None and k is not None and rows.count() != queries * k:
        raise ValueError("the file does not hold queries * k ids")
    return rows


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all machines share; where that is unset in a local
    session, a temporary folder of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="nearsieve-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set of parts of each order."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") + 1).alias("idx")).distinct()


def texts(spark: SparkSession, sf_dir: str, table: str = "documents", key: str = "doc_id") -> DataFrame:
    """``id, text`` of a table of texts."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).alias("id"), "text")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("pos", "val")).select("id", (F.col("pos") + 1).cast("long").alias("idx"), F.col("val").cast("double").alias("val"))


def file_name(part: Column, base: str) -> Column:
    return F.concat(F.lit(base), pad_suffix(part))
