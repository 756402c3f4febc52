"""Copies and passes that a job makes do not grow with the square of its rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import to_df
from embedscope.functions.kernels import nearest_manhattan, pairwise
from embedscope.operators import balls as B
from embedscope.operators import pairs as P


@pytest.mark.parametrize("shift, scale", [(0.0, 1.0), (1e7, 1.0), (0.0, 1e39), (0.0, 1e-45)])
def test_nearest_manhattan_is_exact(shift, scale):
    """Also where single precision cannot tell the rows apart, or overflows."""
    rng = np.random.default_rng(3)
    a, b = shift + rng.normal(size=(20, 6)) * scale, shift + rng.normal(size=(300, 6)) * scale
    b[7, 2], a[3] = np.nan, b[11]
    rows, cols, d = nearest_manhattan(a, b, 4)
    want = np.abs(a[:, None, :] - b[None, :, :]).sum(axis=2)
    want[:, 7] = np.inf
    assert np.array_equal(np.bincount(rows), [4] * 20)
    for i in range(20):
        assert np.allclose(np.sort(d[rows == i]), np.sort(want[i])[:4], rtol=1e-12, atol=0)
        assert np.allclose(want[i, cols[rows == i]], d[rows == i], rtol=1e-12, atol=0)


def test_manhattan_blocks():
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(19, 5)), rng.normal(size=(9000, 5))
    assert np.allclose(pairwise("manhattan", a, b), np.abs(a[:, None, :] - b[None, :, :]).sum(axis=2), atol=1e-12)


def test_blocks_do_not_grow_with_rows():
    """A row is copied once for each block of the other side."""
    for n in (50_000, 100_000, 600_000):
        assert -(-n // P._block_rows(n, None, 64)) <= P.BLOCKS
    assert P._block_rows(10**9, None, 64) * 64 * 8 <= P.BLOCK_BYTES
    assert P._block_rows(10**9, 7, 64) == 7


@pytest.mark.parametrize("chunk", [1, 50, 1 << 22])
def test_chunks_of_a_tile(spark, monkeypatch, chunk):
    monkeypatch.setattr(P, "CHUNK_PAIRS", chunk)
    x = np.random.default_rng(5).normal(size=(60, 3))
    df = to_df(spark, x)
    d = pairwise("euclidean", x, x)
    np.fill_diagonal(d, 0.0)
    got = P.pair_reduce(df, df, P.TopK(3), metric="euclidean", same_ids=True).collect()
    for i in range(60):
        assert np.allclose(sorted(r.d for r in got if r[P.LID] == i), np.sort(d[i])[:3])


def test_balls_are_sent_by_units(spark):
    """Many balls that all meet: a point is sent once for each unit, not for each ball."""
    x = np.random.default_rng(6).normal(size=(500, 3))
    index = B.ball_index(to_df(spark, x), block_rows=24)
    units, balls = index._units(), index.balls.count()
    assert units < balls
    sent = index.reduce(index.tiles(1e9), lambda d, a, b, same: B.pd.DataFrame({"n": [d.size]}), "n long")
    assert sent.agg(F.sum("n")).first()[0] == (500 * 500 + sum(r.n ** 2 for r in index.balls.collect())) / 2
    d = pairwise("euclidean", x, x)
    got = {r.id: list(r.counts) for r in B.count_within(index, [0.5, 1.5]).collect()}
    assert all(got[i] == [(d[i] <= 0.5).sum(), (d[i] <= 1.5).sum()] for i in range(500))


def test_responses_are_read_once(spark):
    from embedscope.operators.consistency import response_metrics
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(40).select((F.col("id") % 8).alias("id"), F.col("id").alias("response_id"),
                                  F.array(F.cos("id"), F.sin("id")).alias("embedding"))
    assert response_metrics(rows.mapInArrow(run, rows.schema)).count() == 8
    assert seen.value == 40
