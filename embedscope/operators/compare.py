"""Comparison of scoring methods (Q12; A20, A21, A23, A24; U1-U3).

Works on the long table ``(prompt, score, method)`` (plus an ``id`` where
available for last-wins de-duplication).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedscope.operators.ranking import global_rank


def long_scores(frames: dict[str, DataFrame], score_cols: dict[str, str] | None = None) -> DataFrame:
    """Bag union of per-method score tables into ``(id, prompt, score,
    method)``."""
    out = None
    for method, df in frames.items():
        col = (score_cols or {}).get(method, "score")
        part = df.select("id", "prompt", F.col(col).cast("double").alias("score"),
                         F.lit(method).alias("method"))
        out = part if out is None else out.unionByName(part)
    return out


def method_statistics(long: DataFrame) -> DataFrame:
    """Per method mean, sample std (pandas' default), min, max, count."""
    s = F.col("score")
    return long.groupBy("method").agg(F.avg(s).alias("mean"), F.stddev_samp(s).alias("std"),
                                      F.min(s).alias("min"), F.max(s).alias("max"),
                                      F.count(s).alias("count"))


def method_correlation(long: DataFrame, method_a: str, method_b: str) -> DataFrame:
    """A21 (J11, U2): Pearson correlation of two methods on their common
    prompts, the last value (largest id) winning for a repeated prompt.  One
    aggregate by a digest of the text, without a join."""
    both = long.where(F.col("method").isin(method_a, method_b)).groupBy(F.sha2("prompt", 256).alias("text")).agg(
        *[F.max_by(F.when(F.col("method") == m, F.col("score")), F.when(F.col("method") == m, F.col("id"))).alias(m)
          for m in (method_a, method_b)],
        *[F.count_if(F.col("method") == m).alias(f"__n{i}") for i, m in enumerate((method_a, method_b))]).where(
        "__n0 > 0 and __n1 > 0")
    return both.agg(F.lit(method_a).alias("method_a"), F.lit(method_b).alias("method_b"),
                    F.corr(method_a, method_b).alias("correlation"),
                    F.count(F.lit(1)).alias("n_common"))


def histogram(long: DataFrame, bins: int = 20, value_col: str = "score",
              group_col: str = "method") -> DataFrame:
    """Equal-width bins between the group's min and max; the last bin
    is closed on the right.  ``(group, bin, lo, hi, count)``; empty bins are
    not listed."""
    rng = long.groupBy(group_col).agg(F.min(value_col).alias("__lo"), F.max(value_col).alias("__hi"))
    x = F.col(value_col)
    width = (F.col("__hi") - F.col("__lo")) / bins
    b = F.when(F.col("__hi") == F.col("__lo"), F.lit(0)).otherwise(
        F.least(F.floor((x - F.col("__lo")) / width), F.lit(bins - 1))).cast("int")
    binned = long.join(rng, group_col).select(group_col, b.alias("bin"), "__lo", "__hi")
    return binned.groupBy(group_col, "bin").agg(
        F.count(F.lit(1)).alias("count"),
        (F.first("__lo") + F.col("bin") * (F.first("__hi") - F.first("__lo")) / bins).alias("lo"),
        (F.first("__lo") + (F.col("bin") + 1) * (F.first("__hi") - F.first("__lo")) / bins).alias("hi"))


def grouped_quantiles(df: DataFrame, value_col: str, group_col: str,
                      probs: dict[str, float]) -> DataFrame:
    """Exact per-group quantiles (linear interpolation) without one task per
    group: values are ranked by the distributed global rank on
    ``(group, value)``, the group's first position gives its offset."""
    vals = (df.select(F.col(group_col).alias("g"), F.col(value_col).alias("x"))
            .where(F.col("x").isNotNull())
            .withColumn("__t", F.monotonically_increasing_id()))
    ranked = global_rank(vals, [F.col("g"), F.col("x"), F.col("__t")], "pos")
    offs = ranked.groupBy("g").agg((F.min("pos") - 1).alias("off"), F.count(F.lit(1)).alias("n"))
    local = ranked.join(offs, "g").select("g", "x", "n", (F.col("pos") - F.col("off")).alias("p"))
    wanted = None
    aggs = []
    for name, q in probs.items():
        h = (F.col("n") - 1) * F.lit(float(q)) + 1
        lo, hi = F.floor(h), F.ceil(h)
        cond = (F.col("p") == lo) | (F.col("p") == hi)
        wanted = cond if wanted is None else wanted | cond
        lo_v = F.max(F.when(F.col("p") == lo, F.col("x")))
        hi_v = F.max(F.when(F.col("p") == hi, F.col("x")))
        aggs.append((lo_v + (hi_v - lo_v) * F.max(h - lo)).alias(name))
    return local.where(wanted).groupBy(F.col("g").alias(group_col)).agg(*aggs)


def box_stats(long: DataFrame, value_col: str = "score", group_col: str = "method") -> DataFrame:
    """Quartiles, whiskers (most extreme values within 1.5 IQR of the
    box) and outlier count per group."""
    q = grouped_quantiles(long, value_col, group_col,
                          {"q1": 0.25, "median": 0.5, "q3": 0.75})
    x = F.col(value_col)
    iqr = F.col("q3") - F.col("q1")
    lo_fence, hi_fence = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    j = long.join(q, group_col)
    return j.groupBy(group_col, "q1", "median", "q3").agg(
        F.min(F.when(x >= lo_fence, x)).alias("whisker_low"),
        F.max(F.when(x <= hi_fence, x)).alias("whisker_high"),
        F.count_if((x < lo_fence) | (x > hi_fence)).alias("n_outliers"))


def distinct_methods(long: DataFrame) -> DataFrame:
    """U3."""
    return long.select("method").distinct()
