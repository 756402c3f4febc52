"""Corpus scores (Q3/Q4), distribution (A5), ranking helpers."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import to_df
from reference_impl import cos_lib, euclid
from embedscope.operators.ranking import global_rank, rank_within
from embedscope.operators.scoring import corpus_scores, distribution


def _bf(method, q, c, k):
    if method == "cosine":
        d = cos_lib(q, c)
    elif method == "euclidean":
        d = euclid(q, c)
    elif method == "manhattan":
        d = np.abs(q[:, None] - c[None]).sum(-1)
    elif method == "faiss_cosine":
        un = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
        d = 1 - un(q) @ un(c).T
    else:
        d = euclid(q, c) ** 2
    s = np.sort(d, axis=1)[:, :min(k, c.shape[0])].mean(axis=1)
    dim = q.shape[1]
    bound = {"cosine": 1, "faiss_cosine": 1, "euclidean": 2 * np.sqrt(dim),
             "faiss_l2": 2 * np.sqrt(dim), "manhattan": 2 * dim}[method]
    return np.minimum(s / bound, 1.0)


@pytest.mark.parametrize("method", ["cosine", "euclidean", "manhattan", "faiss_cosine", "faiss_l2"])
@pytest.mark.parametrize("k", [3, 50])
def test_corpus_scores(spark, method, k):
    rng = np.random.default_rng(1)
    q, c = rng.normal(size=(12, 6)), rng.normal(size=(20, 6))
    got = {r["id"]: r["score"] for r in corpus_scores(to_df(spark, q), to_df(spark, c, ids=range(100, 120)),
                                                      method=method, top_k=k).collect()}
    want = _bf(method, q, c, k)
    assert np.allclose([got[i] for i in range(12)], want, atol=1e-9)


def test_empty_corpus_and_bad_method(spark):
    q = to_df(spark, np.ones((3, 2)))
    empty = q.where("id < 0")
    assert [r["score"] for r in corpus_scores(q, empty).collect()] == [1.0] * 3
    with pytest.raises(ValueError):
        corpus_scores(q, q, method="nope")
    with pytest.raises(ValueError):
        corpus_scores(q, q, top_k=0)


def test_distribution_exact(spark):
    vals = np.random.default_rng(5).random(101)
    df = spark.createDataFrame([(float(v),) for v in vals], "score double")
    r = distribution(df, threshold=0.5).first()
    for name, p in [("median", 50), ("percentile_25", 25), ("percentile_90", 90), ("percentile_95", 95)]:
        assert abs(r[name] - np.percentile(vals, p)) < 1e-12
    assert r["above_threshold"] == (vals > 0.5).sum() and abs(r["std"] - vals.std()) < 1e-12


def test_global_rank_with_ties(spark):
    rows = [(i, float(i % 7)) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, s double")
    got = {r["id"]: r["rank"] for r in global_rank(df, [F.col("s").desc(), F.col("id")], partitions=5).collect()}
    want = {i: k + 1 for k, (i, _) in enumerate(sorted(rows, key=lambda t: (-t[1], t[0])))}
    assert got == want
    inner = rank_within(df.withColumn("g", F.col("id") % 3), ["g"], [F.col("s"), F.col("id")]).collect()
    for g in range(3):
        mine = sorted([r for r in inner if r["g"] == g], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        assert [(r["s"], r["id"]) for r in mine] == sorted((r["s"], r["id"]) for r in mine)
