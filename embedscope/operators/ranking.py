"""Global ranking (W1), top-k (W3) and last-k.

A window without PARTITION BY runs in a single task.  ``global_rank``
instead range-partitions and sorts once, writes the rows with their partition
and position, and adds the row count of all earlier partitions, read from the
written table (one row per partition, so its broadcast is bounded by the
partition count).  Reading the counts from a second evaluation would be wrong:
a range exchange samples its boundaries anew whenever it runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embedscope.session import cut_lineage

_LOW33 = (1 << 33) - 1


def global_rank(df: DataFrame, order: list[Column], name: str = "rank",
                partitions: int | None = None) -> DataFrame:
    """Consecutive 1..n rank in ``order`` (which must be a total order, so
    include a unique key last).  Ties in the score therefore keep key order,
    as a stable sort would."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = df.columns
    numbered = (cut_lineage(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                            .withColumn("__mid", F.monotonically_increasing_id()))
                .withColumn("__pid", F.shiftright("__mid", 33))
                .withColumn("__loc", F.col("__mid").bitwiseAND(F.lit(_LOW33))))
    sizes = numbered.groupBy("__pid").agg((F.max("__loc") + 1).alias("__cnt"))
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__pid", F.coalesce(F.sum("__cnt").over(before), F.lit(0)).alias("__off"))
    return (numbered.join(F.broadcast(offsets), "__pid")
            .select(*cols, (F.col("__off") + F.col("__loc") + 1).cast("bigint").alias(name)))


def top_k(df: DataFrame, order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First k rows in ``order`` with positions 1..k (TakeOrderedAndProject)."""
    w = Window.orderBy(*order)
    return df.orderBy(*order).limit(k).withColumn(name, F.row_number().over(w))


def last_k(df: DataFrame, order: list[Column], reverse: list[Column], k: int,
           name: str = "position") -> DataFrame:
    """Last k rows of the ranking, kept in ranking order and renumbered 1..k."""
    tail = df.orderBy(*reverse).limit(k)
    return tail.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def rank_within(df: DataFrame, group: list[str], order: list[Column], name: str = "rank",
                partitions: int | None = None) -> DataFrame:
    """1..n rank inside each group without a per-group task: the global
    rank on ``(group, order)`` minus the first position of the group.  A
    group holding a third of all rows is still spread over many range
    partitions."""
    ranked = global_rank(df, [F.col(g) for g in group] + order, "__pos", partitions)
    first = ranked.groupBy(*group).agg(F.min("__pos").alias("__first"))
    return (ranked.join(first, group)
            .withColumn(name, (F.col("__pos") - F.col("__first") + 1).cast("bigint"))
            .drop("__pos", "__first"))
