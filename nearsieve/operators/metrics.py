"""Similarities of results, and quality at k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearsieve.functions.scalars import cosine


def pair_dots(pairs: DataFrame, long: DataFrame) -> DataFrame:
    """``qid, id, dot, qnorm2, norm2`` of ``pairs(qid, id)`` over ``long(id, idx, val)``; 0 where nothing is shared."""
    norms = long.groupBy("id").agg(F.sum(F.col("val") * F.col("val")).alias("norm2"))
    q = long.select(F.col("id").alias("qid"), "idx", F.col("val").alias("qval"))
    dots = pairs.select("qid", "id").join(q, "qid").join(long, ["id", "idx"]).groupBy("qid", "id").agg(F.sum(F.col("qval") * F.col("val")).alias("dot"))
    full = pairs.select("qid", "id").join(dots, ["qid", "id"], "left").join(norms, "id", "left").join(norms.select(F.col("id").alias("qid"), F.col("norm2").alias("qnorm2")), "qid", "left")
    return full.select("qid", "id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("dot", "qnorm2", "norm2")])


def pair_cosines(pairs: DataFrame, long: DataFrame) -> DataFrame:
    return pair_dots(pairs, long).select("qid", "id", cosine(F.col("dot"), F.col("qnorm2"), F.col("norm2")).alias("cosine"))


def similarity_at(results: DataFrame, long: DataFrame, queries: int, ks: list[int]) -> DataFrame:
    """``k, similarity``: mean cosine over the first k ranks, over queries * k even if fewer are found."""
    scored = results.select("qid", "rank", "id").join(pair_cosines(results, long), ["qid", "id"])
    sums = scored.agg(*[F.coalesce(F.sum(F.when(F.col("rank") < k, F.col("cosine"))), F.lit(0.0)).alias(f"s{k}") for k in ks])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col(f"s{k}") / (queries * k)).alias("similarity")) for k in ks])).alias("x")).select("x.*")


def norm2_similarity(results: DataFrame, long: DataFrame) -> DataFrame:
    """Mean over queries of the mean of dot / (|q|^2 |v|^2), zero norms left out."""
    dots = pair_dots(results, long).filter(F.col("qnorm2") * F.col("norm2") > 0)
    each = dots.groupBy("qid").agg(F.avg(F.col("dot") / (F.col("qnorm2") * F.col("norm2"))).alias("s"))
    return each.agg(F.avg("s").alias("similarity"))


def mean_pairwise_cosine(long: DataFrame) -> DataFrame:
    """Mean cosine over all ordered pairs of different rows, without forming a pair: the squared
    length of the sum of unit vectors, less each vector with itself. Zero vectors count with cosine 0."""
    norms = long.groupBy("id").agg(F.sqrt(F.sum(F.col("val") * F.col("val"))).alias("norm"))
    unit = long.join(norms, "id").select("idx", F.when(F.col("norm") > 0, F.col("val") / F.col("norm")).otherwise(0.0).alias("u"))
    whole = unit.groupBy("idx").agg(F.sum("u").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("total"))
    count = norms.agg(F.count("*").alias("n"), F.count_if(F.col("norm") > 0).alias("filled"))
    return whole.crossJoin(count).select(((F.col("total") - F.col("filled")) / (F.col("n") * (F.col("n") - 1))).alias("mean_cosine"))  # a row by a row


def z_scores(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``key, z`` by the sample deviation; null where it is 0."""
    stats = rows.agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    return rows.join(F.broadcast(stats), how="cross").select(key, F.when(F.col("s") > 0, (F.col(value) - F.col("m")) / F.col("s")).alias("z"))  # one row is broadcast


def recall(results: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of the true neighbours that the results hold."""
    hits = truth.select("qid", "id").join(results.select("qid", "id").withColumn("hit", F.lit(1)), ["qid", "id"], "left")
    return hits.agg(F.count("*").alias("truth"), F.count("hit").alias("found"), (F.count("hit") / F.count("*")).alias("recall"))


def sample_rows(rows: DataFrame, n: int, key: str = "id", seed: int = 3) -> DataFrame:
    """n rows without replacement, by a hash of the key."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def prefix_means(results: DataFrame, value: str) -> DataFrame:
    """Running mean over ranks of each query."""
    frame = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return results.withColumn("mean", F.avg(value).over(frame))
