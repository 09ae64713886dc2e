"""Connected components as joins and minima, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearsieve.llm.env import cut


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; root is the least node reachable.

    Every round each node takes the least root among its own and its
    neighbours', then the root of that root, so long chains shrink by halves.
    Each round is cut, and the loop ends when no root changes. Minima are
    combined before each shuffle, so a node with very many neighbours is no
    hot key; the joins can be split by the adaptive planner. Edges that hold a
    null are left out; no edges give no rows.
    """
    edges = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").distinct(), "edges")
    least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
    roots = cut(least.select("node", F.least("node", "near").alias("root")), "roots")
    while True:
        near = both.join(roots.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = roots.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        up = roots.select(F.col("node").alias("root"), F.col("root").alias("top"))
        new = cut(step.join(up, "root", "left").select("node", "old", F.least("root", F.coalesce("top", "root")).alias("root")), "roots")
        if not new.filter("root <> old").head(1):
            return new.select("node", "root")
        roots = new.select("node", "root")
