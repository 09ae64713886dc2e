"""The index: bounded buckets of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearsieve.config import KnnConfig
from nearsieve.functions.u32 import fold, mask, mul


def id_order(id_: Column, cfg: KnnConfig) -> Column:
    """A seeded hash by which reservoirs choose; any ids, by their low 32 bits."""
    return fold(mul(mask(id_ + 1), cfg.constants["id"]), 16)


def reservoirs(addressed: DataFrame, cfg: KnnConfig) -> DataFrame:
    """``tbl, bucket, slot, id, n_seen``: the ``reservoir`` ids of least hash in each bucket.

    A uniform sample without replacement that does not depend on order or
    partitions. The rank is bounded, so Spark keeps ``reservoir`` rows of a
    bucket in each task before the shuffle; sizes are counted by an aggregate.
    """
    order = Window.partitionBy("tbl", "bucket").orderBy(id_order(F.col("id"), cfg), "id")
    kept = addressed.withColumn("slot", F.row_number().over(order) - 1).filter(F.col("slot") < cfg.reservoir)
    seen = addressed.groupBy("tbl", "bucket").agg(F.count("*").alias("n_seen"))
    return kept.join(seen, ["tbl", "bucket"]).select("tbl", "bucket", "slot", "id", "n_seen")


def merge_index(index: DataFrame, addressed: DataFrame, cfg: KnnConfig) -> DataFrame:
    """The index of old and new rows together: bottom-R samples merge exactly."""
    old = index.select("tbl", "bucket", "id")
    order = Window.partitionBy("tbl", "bucket").orderBy(id_order(F.col("id"), cfg), "id")
    rows = old.union(addressed.select("tbl", "bucket", "id"))
    kept = rows.withColumn("slot", F.row_number().over(order) - 1).filter(F.col("slot") < cfg.reservoir)
    before = index.groupBy("tbl", "bucket").agg(F.max("n_seen").alias("n"))
    added = addressed.groupBy("tbl", "bucket").agg(F.count("*").alias("n"))
    seen = before.union(added).groupBy("tbl", "bucket").agg(F.sum("n").alias("n_seen"))
    return kept.join(seen, ["tbl", "bucket"]).select("tbl", "bucket", "slot", "id", "n_seen")


def persisted(index: DataFrame, path: str) -> DataFrame:
    """The index written to ``path``, a folder a table, and read again: built once for any number of queries."""
    index.repartition("tbl", "bucket").sortWithinPartitions("tbl", "bucket", "slot").write.mode("overwrite").partitionBy("tbl").parquet(path)
    return index.sparkSession.read.schema(index.schema).parquet(path).select(index.columns)


def occupancy(addressed: DataFrame, cfg: KnnConfig) -> DataFrame:
    """Least, greatest and mean share of buckets in use over tables."""
    share = addressed.groupBy("tbl").agg((F.countDistinct("bucket") / 2**cfg.address_bits).alias("share"))
    return share.agg(F.min("share").alias("min_share"), F.max("share").alias("max_share"), F.avg("share").alias("avg_share"))
