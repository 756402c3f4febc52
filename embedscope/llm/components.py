"""Connected components of an edge table by large-star / small-star rounds.

Each step needs only the smallest neighbour of a node, which is an aggregate
with partial aggregation, and a join that adaptive execution can split, so a
node with very many neighbours is no hot task.  Every round is written to the
shared folder; the edge table never grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedscope.llm.work import Cuts

#: Rows that a task writes; keeps small rounds from writing many small files.
ROWS_A_TASK = 100_000


def components(edges: DataFrame, cuts: Cuts, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges (a, b)``; the component is
    named by its smallest node.  Loops, repeats and an empty table are allowed."""
    stars = cuts.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                     .distinct())
    for _ in range(max_rounds):
        several = stars.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u")
        inner = stars.select("u").join(stars.select(F.col("v").alias("u")), "u", "left_semi")
        if several.unionByName(inner).isEmpty():  # each node points at a root
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        tasks = max(1, stars.count() // ROWS_A_TASK)
        large = cuts.cut(large.coalesce(tasks))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        new = cuts.cut(small.coalesce(tasks))
        cuts.drop(stars, large)
        stars = new
    raise RuntimeError(f"components not found after {max_rounds} rounds")
