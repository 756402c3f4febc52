"""The pivot index against brute force; tiles that it leaves out."""

from __future__ import annotations

import numpy as np
import pytest

from conftest import planted_clusters, to_df
from embedscope.functions.kernels import pairwise
from embedscope.operators import balls as B
from embedscope.operators import density as D
from reference_impl import dbscan as bf_dbscan


def clustered(seed=5, clusters=8, size=40, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-10, 10, size=(clusters, dim))
    x = np.vstack([c + rng.normal(0, 0.3, size=(size, dim)) for c in centres])
    x[5:50] = x[5]  # copies: more than a ball holds
    return x


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine"])
@pytest.mark.parametrize("block", [60])
def test_searches_equal_brute_force(spark, metric, block):
    x = clustered()
    x[70] = 0.0
    ids = np.random.default_rng(1).permutation(len(x)) - 100  # ids below zero too
    d = pairwise(metric, x, x)
    np.fill_diagonal(d, 0.0)
    index = B.ball_index(to_df(spark, x, ids=ids), metric, block_rows=block)
    assert index.points.groupBy("ball").count().agg({"count": "max"}).first()[0] <= 3 * block
    for k in (4, 60):
        got = {}
        for r in B.nearest(index, k).collect():
            got.setdefault(r.id, []).append((r.nn, r.d))
        for i, row in zip(ids.tolist(), d):
            assert [n for n, _ in sorted(got[i])] == list(range(1, k + 1))
            np.testing.assert_allclose([v for _, v in sorted(got[i])], np.sort(row)[:k], atol=1e-6)
    eps = sorted(np.quantile(d, [0.01, 0.2]) + 1e-5)
    got = {r.id: r.counts for r in B.count_within(index, eps).collect()}
    assert all(got[i] == [(row <= e).sum() for e in eps] for i, row in zip(ids.tolist(), d))


def test_tiles_of_far_balls_are_left_out(spark):
    index = B.ball_index(to_df(spark, clustered(clusters=12, size=60)), block_rows=32)
    n = index.balls.count()
    kept, skipped = index.tile_counts(0.5)
    assert n >= 20 and kept + skipped == n * (n + 1) // 2
    assert skipped > 0.7 * (kept + skipped)
    assert index.tile_counts(1e9)[1] == 0


@pytest.mark.parametrize("block,eps,least", [(16, 0.15, 3), (50, 0.6, 4)])
def test_dbscan_over_many_balls(spark, block, eps, least):
    x = np.vstack([clustered(dim=2, clusters=5, size=50), planted_clusters(noise=30)])
    got = {r.id: r.label for r in D.dbscan_multi(to_df(spark, x), [eps], least, block_rows=block).collect()}
    assert [got[i] for i in range(len(x))] == bf_dbscan(x, eps, least).tolist()


def test_several_eps_at_once(spark):
    x = clustered(dim=2)
    rows = D.dbscan_multi(to_df(spark, x), [0.1, 0.4, 2.0], 3, block_rows=30).collect()
    for c, eps in enumerate([0.1, 0.4, 2.0]):
        got = {r.id: r.label for r in rows if r.cfg == c}
        assert [got[i] for i in range(len(x))] == bf_dbscan(x, eps, 3).tolist()


def test_unknown_metric_and_few_points(spark):
    with pytest.raises(ValueError, match="bounds"):
        B.ball_index(to_df(spark, clustered()), "cosine_raw")
    one = B.ball_index(to_df(spark, np.array([[1.0, 2.0]])))
    assert [(r.id, r.d, r.nn) for r in B.nearest(one, 3).collect()] == [(0, 0.0, 1)]
    none = B.ball_index(to_df(spark, clustered()).where("false"))
    assert B.nearest(none, 3).count() == 0 and B.count_within(none, [1.0]).count() == 0
    assert D.dbscan(to_df(spark, clustered()).where("false"), 0.3).count() == 0
