"""Queries: probing the index, and top-K by exact counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearsieve.config import KnnConfig

EVERY = 20  # rows whose id is divisible by this are queries


def probe(asked: DataFrame, index: DataFrame, own: bool = False) -> DataFrame:
    """``qid, tbl, slot, id``: the bag of ids in the buckets of each query.

    ``asked(id, tbl, bucket)``. Buckets are bounded, so the fan-out of a query
    is at most tables * reservoir; the join's strategy is left to the planner,
    which splits hot buckets.
    """
    found = asked.withColumnRenamed("id", "qid").join(index.select("tbl", "bucket", "slot", "id"), ["tbl", "bucket"])
    return found.filter(F.lit(own) | (F.col("qid") != F.col("id"))).select("qid", "tbl", "slot", "id")


def probe_lists(asked: DataFrame, index: DataFrame) -> DataFrame:
    """``qid, tbl, ids``: a bucket's whole list of ids, by slot, for each table of a query; its own id is among them.

    A tenth of the bytes of ``probe``: results go by query in one shuffle of lists.
    """
    lists = index.groupBy("tbl", "bucket").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "id"))), lambda x: x["id"]).alias("ids"))
    return asked.withColumnRenamed("id", "qid").join(lists, ["tbl", "bucket"]).select("qid", "tbl", "ids")


def top_by_count(candidates: DataFrame, k: int, own: bool = False) -> DataFrame:
    """``qid, rank, id, n``: the k most frequent ids, ties to the smaller id; ranks from 0.

    ``candidates`` are those of ``probe`` or ``probe_lists``. One shuffle by query
    serves the counts and the ranks; a query has at most tables * reservoir candidates.
    """
    near = candidates.repartition("qid")
    if "ids" in near.columns:
        near = near.select("qid", F.explode("ids").alias("id")).filter(F.lit(own) | (F.col("qid") != F.col("id")))
    return ranked(near.groupBy("qid", "id").agg(F.count("*").alias("n")), k)


def ranked(counts: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("n"), "id")
    return counts.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < k).select("qid", "rank", "id", "n")


def exact_jaccard(long: DataFrame, k: int, every: int = EVERY) -> DataFrame:
    """Ground truth: the k nearest by Jaccard similarity among all that share a feature."""
    sets = long.select("id", "idx").distinct()
    sizes = sets.groupBy("id").agg(F.count("*").alias("size"))
    q = sets.filter(F.col("id") % every == 0).withColumnRenamed("id", "qid")
    both = q.join(sets, "idx").filter("qid <> id").groupBy("qid", "id").agg(F.count("*").alias("both"))
    full = both.join(sizes, "id").join(sizes.select(F.col("id").alias("qid"), F.col("size").alias("qsize")), "qid")
    near = full.select("qid", "id", F.round(F.col("both") / (F.col("size") + F.col("qsize") - F.col("both")), 6).alias("jaccard"))
    order = Window.partitionBy("qid").orderBy(F.desc("jaccard"), "id")
    return near.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < k).select("qid", "rank", "id", "jaccard")


def batched(asked: DataFrame, index: DataFrame, cfg: KnnConfig, count: int) -> DataFrame:
    """The queries in ``count`` batches by id, each answered alone, results appended."""
    out = None
    for b in range(count):
        part = top_by_count(probe_lists(asked.filter(F.pmod(F.expr(f"id div {EVERY}"), F.lit(count)) == b), index), cfg.top_k)
        out = part if out is None else out.union(part)
    return out
