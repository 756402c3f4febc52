"""Ranks over inputs that are larger than a range exchange's sample."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from embedscope.operators.ranking import global_rank, rank_within
from embedscope.operators.scoring import exact_quantiles


def frame(spark, n):
    return spark.range(n).select(
        "id", (F.pmod(F.xxhash64("id"), F.lit(n // 3)) / 7).alias("x"), F.sha2(F.col("id").cast("string"), 256).alias("load"),
        (F.col("id") % 5 * (F.col("id") % 3 == 0).cast("int")).alias("g"))


@pytest.mark.parametrize("n,parts", [(1_000_000, 8), (100_000, 3), (100_000, 31)])
def test_global_rank_is_dense(spark, n, parts):
    r = global_rank(frame(spark, n), [F.col("x").desc(), F.col("id")], partitions=parts)
    got = r.agg(F.countDistinct("rank"), F.min("rank"), F.max("rank")).first()
    assert tuple(got) == (n, 1, n)
    if n == 100_000:
        want = F.row_number().over(Window.orderBy(F.col("x").desc(), F.col("id")))
        assert r.withColumn("want", want).where("rank <> want").isEmpty()


def test_rank_within(spark):
    r = rank_within(frame(spark, 100_000), ["g"], [F.col("x"), F.col("id")])
    want = F.row_number().over(Window.partitionBy("g").orderBy("x", "id"))
    assert r.withColumn("want", want).where("rank <> want").isEmpty() and r.count() == 100_000


def test_exact_quantiles(spark):
    f = frame(spark, 100_000)
    got = exact_quantiles(f, "x", {"a": 0.25, "b": 0.5, "c": 0.9}).first()
    want = f.agg(*[F.percentile("x", p) for p in (0.25, 0.5, 0.9)]).first()
    assert [got["a"], got["b"], got["c"]] == pytest.approx(list(want))
