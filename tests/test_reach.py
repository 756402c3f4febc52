"""Pairs that the pivot index need not measure."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import to_df
from reference_impl import dbscan as bf_dbscan
from reference_impl import euclid


def test_rows_apart_on_a_line_do_not_meet(spark):
    """Clusters of many dimensions: balls overlap by their radii, their rows do not meet."""
    import pandas as pd
    from embedscope.operators import balls as B
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.arange(400) % 2
    x[np.arange(400), label] += 2.0
    index = B.ball_index(to_df(spark, x), block_rows=60)
    eps = 1.2
    tiles = index.tiles(B.search_limit("euclidean", eps))
    measured = index.reduce(tiles, lambda d, a, b, own: pd.DataFrame({"n": [0 if own else d.size]}), "n long").agg(F.sum("n")).first()[0]
    assert measured <= 2 * 200 * 200 / 2  # pairs within the two clusters
    d = euclid(x, x)
    got = {r["id"]: r["counts"][0] for r in B.count_within(index, [eps]).collect()}
    assert [got[i] for i in range(400)] == (d <= eps).sum(axis=1).tolist()


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "manhattan"])
def test_sweep_over_several_balls(spark, metric):
    """Roots that tiles link, and border points of several clusters, for every eps."""
    from embedscope.operators.density import dbscan_multi
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(c, 0.6, size=(50, 3)) for c in (-3, 0, 3)] + [rng.uniform(-6, 6, size=(30, 3)), np.zeros((1, 3))])
    eps = {"euclidean": [0.4, 0.7, 1.1], "cosine": [0.02, 0.05, 1.0], "manhattan": [0.6, 1.2, 1.8]}[metric]
    many = {(r["eps"], r["id"]): r["label"] for r in dbscan_multi(to_df(spark, x), eps, 4, metric, block_rows=25).collect()}
    one = {(r["eps"], r["id"]): r["label"] for r in dbscan_multi(to_df(spark, x), eps, 4, metric).collect()}
    assert many == one
    if metric == "euclidean":
        for e in eps:
            assert [many[(e, i)] for i in range(len(x))] == list(bf_dbscan(x, e, 4))
