"""Corpus scoring (Q3/Q4) and score distributions (A5).

The corpus score of a vector is the mean of its ``top_k`` smallest
distances to a reference corpus, optionally normalised per method (P10).
All queries are scored in one plan by the pair kernel, which keeps only
per-tile top-k partials and merges them with a limited window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedscope.functions import vectors as V
from embedscope.operators.pairs import LID, TopK, pair_reduce
from embedscope.operators.ranking import global_rank

# Kernel metric per corpus method.
_KERNEL_METRIC = {"cosine": "cosine", "euclidean": "euclidean", "manhattan": "manhattan",
                  "faiss_cosine": "faiss_cosine", "faiss_l2": "sqeuclidean"}


def corpus_scores(queries: DataFrame, corpus: DataFrame, method: str = "cosine", top_k: int = 5,
                  normalize: bool = True, float32: bool = False, id_col: str = "id",
                  vec_col: str = "embedding") -> DataFrame:
    """Q4: ``(id, score)`` for every query row.

    An empty corpus gives 1.0 for every row.  ``float32`` rounds both sides
    to single precision first (parity with the single-precision search).
    """
    if method not in _KERNEL_METRIC:
        raise ValueError(f"no distance is named {method}")
    if top_k <= 0:
        raise ValueError("top_k must be positive")
    q = queries.select(F.col(id_col).alias("id"), F.col(vec_col).alias("embedding"))
    c = corpus.select(F.col(id_col).alias("cid"), F.col(vec_col).alias("embedding"))
    if float32:
        q = q.withColumn("embedding", V.as_float("embedding"))
        c = c.withColumn("embedding", V.as_float("embedding"))
    near = pair_reduce(q, c, TopK(top_k), metric=_KERNEL_METRIC[method],
                       right_id_col="cid")
    mean = near.groupBy(F.col(LID).alias("id")).agg(F.avg("d").alias("raw"))
    scored = q.select("id", V.dim("embedding").alias("dim")).join(mean, "id", "left")
    s = F.col("raw")
    if normalize:
        s = V.normalize_score(method, s, "dim")
    return scored.select("id", F.coalesce(s, F.lit(1.0)).alias("score"))


def corpus_score_one(vec: DataFrame, corpus: DataFrame, **kw) -> DataFrame:
    """Q3: the same for one vector (a one-row DataFrame)."""
    return corpus_scores(vec, corpus, **kw)


def exact_quantiles(df: DataFrame, col: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation (NumPy's default), without
    gathering the column in one task: rank the values with the distributed
    global rank, keep only the rows at the needed positions, interpolate.
    One row, one column per name in ``probs``."""
    vals = df.select(F.col(col).alias("x")).where(F.col("x").isNotNull())
    ranked = global_rank(vals.withColumn("__t", F.monotonically_increasing_id()),
                         [F.col("x"), F.col("__t")], "pos")
    n = vals.agg(F.count(F.lit(1)).alias("n"))
    with_n = ranked.withColumn("__one", F.lit(1)).join(
        F.broadcast(n.withColumn("__one", F.lit(1))), "__one")
    aggs = []
    for name, p in probs.items():
        h = (F.col("n") - 1) * F.lit(float(p)) + 1
        lo, hi = F.floor(h), F.ceil(h)
        frac = h - lo
        lo_v = F.max(F.when(F.col("pos") == lo, F.col("x")))
        hi_v = F.max(F.when(F.col("pos") == hi, F.col("x")))
        aggs.append((lo_v + (hi_v - lo_v) * F.max(frac)).alias(name))
    wanted = None
    for p in probs.values():
        h = (F.col("n") - 1) * F.lit(float(p)) + 1
        cond = (F.col("pos") == F.floor(h)) | (F.col("pos") == F.ceil(h))
        wanted = cond if wanted is None else (wanted | cond)
    return with_n.where(wanted).agg(*aggs)


QUANTILES = {"median": 0.5, "percentile_25": 0.25, "percentile_75": 0.75,
             "percentile_90": 0.9, "percentile_95": 0.95}


def distribution(scores: DataFrame, col: str = "score", threshold: float = 0.5,
                 approximate: bool = False) -> DataFrame:
    """A5: mean, population std, min, max, median, p25/p75/p90/p95, counts
    strictly above and at-or-below the threshold.  ``approximate`` uses
    ``percentile_approx`` (one pass) instead of the exact ranked form."""
    x = F.col(col)
    base = scores.agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"),
                      F.min(x).alias("min"), F.max(x).alias("max"),
                      F.count_if(x > threshold).alias("above_threshold"),
                      F.count_if(x <= threshold).alias("below_threshold"))
    if approximate:
        q = scores.agg(*[F.percentile_approx(x, p, 10000).alias(n) for n, p in QUANTILES.items()])
    else:
        q = exact_quantiles(scores, col, QUANTILES)
    from embedscope.operators.clusters import join_single_rows
    out = join_single_rows(base, q)
    return out.select("mean", "std", "min", "max", *QUANTILES.keys(), "above_threshold",
                      "below_threshold", F.lit(float(threshold)).alias("threshold"))


def threshold_flags(scores: DataFrame, col: str = "score", threshold: float = 0.5) -> Column:
    """P14 as a column: true when the score is strictly above the threshold."""
    return F.col(col) > F.lit(float(threshold))
