"""Pair kernel: results equal brute force and do not depend on blocks."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import planted_clusters, to_df
from reference_impl import cos_lib, euclid
from embedscope.operators.pairs import (G, LID, RID, CountWithin, LabelSums, PairStats, TopK,
                                        pair_reduce)


@pytest.mark.parametrize("block", [3, 7, 2048])
def test_topk_matches_bruteforce(spark, block):
    x = planted_clusters(dim=4)
    df = to_df(spark, x)
    out = pair_reduce(df, df, TopK(4), metric="euclidean", same_ids=True, block_rows=block)
    got = {(r[LID], r["nn"]): r["d"] for r in out.collect()}
    d = euclid(x, x)
    np.fill_diagonal(d, 0.0)
    for i in range(len(x)):
        want = np.sort(d[i])[:4]
        assert np.allclose([got[(i, k)] for k in range(1, 5)], want, atol=1e-9)


@pytest.mark.parametrize("block", [4, 2048])
def test_label_sums(spark, sample, block):
    x, labels, df = sample
    out = pair_reduce(df, df, LabelSums("label"), metric="cosine", rattrs=("label",),
                      same_ids=True, block_rows=block).collect()
    d = cos_lib(x, x)
    np.fill_diagonal(d, 0.0)
    for r in out:
        mask = labels == r["label"]
        assert r["n"] == mask.sum()
        assert abs(r["sum_d"] - d[r[LID], mask].sum()) < 1e-9


def test_count_within(spark, sample):
    x, _, df = sample
    out = {r[LID]: r["n"] for r in pair_reduce(df, df, CountWithin(0.3), metric="euclidean",
                                               same_ids=True, block_rows=5).collect()}
    d = euclid(x, x)
    assert all(out[i] == (d[i] <= 0.3).sum() for i in range(len(x)))


def test_pair_stats_with_hot_group(spark):
    """One group holds most rows: it is split into blocks, tiny groups are
    packed; statistics equal the brute force ones."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 5))
    groups = np.array([0] * 40 + [g for g in range(1, 11) for _ in range(2)])
    rows = [(int(g), int(i), [float(v) for v in x[i]]) for i, g in enumerate(groups)]
    df = spark.createDataFrame(rows, "g bigint, rid bigint, embedding array<double>")
    for block in (6, 2048):
        out = {r[G]: r for r in pair_reduce(df, df, PairStats(), metric="cosine", id_col="rid",
                                            group_col="g", same_ids=True, block_rows=block).collect()}
        for g in set(groups.tolist()):
            idx = np.nonzero(groups == g)[0]
            d = cos_lib(x[idx], x[idx])
            vals = d[~np.eye(len(idx), dtype=bool)]
            r = out[g]
            assert r["n"] == vals.size
            assert abs(r["s"] - vals.sum()) < 1e-9
            assert abs(r["mn"] - vals.min()) < 1e-12 and abs(r["mx"] - vals.max()) < 1e-12


def test_cosine_scale_invariant(spark, sample):
    x, labels, df = sample
    scaled = to_df(spark, x * 7.5, labels)
    a = pair_reduce(df, df, TopK(3), metric="cosine", same_ids=True).orderBy(LID, "nn").collect()
    b = pair_reduce(scaled, scaled, TopK(3), metric="cosine", same_ids=True).orderBy(LID, "nn").collect()
    assert np.allclose([r["d"] for r in a], [r["d"] for r in b], atol=1e-12)


@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
def test_hot_group_and_plan(spark, monkeypatch, broadcast_rows):
    """A group with a third of the rows, many small ones, and a null group; no
    cross join in the plan, whichever way the block plan comes in."""
    from embedscope.operators import pairs
    monkeypatch.setattr(pairs, "PLAN_BROADCAST_ROWS", broadcast_rows)
    rows = spark.range(3000).selectExpr(
        "id", "case when id % 3 = 0 then 0 when id = 1 then null else id % 200 + 1 end as g",
        "array(cast(id % 17 as double), cast(id % 5 as double) + 1) as embedding")
    out = pair_reduce(rows, rows, PairStats(), metric="euclidean", group_col="g", same_ids=True, block_rows=64)
    plan = out._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    got = {r[G]: r for r in out.collect()}
    pdf = rows.where("g is not null").toPandas()
    for g, part in pdf.groupby("g"):
        x = np.stack(part["embedding"].to_numpy())
        if len(x) > 1:
            assert got[g]["n"] == len(x) * (len(x) - 1)
            assert got[g]["s"] == pytest.approx(euclid(x, x).sum(), rel=1e-6)


def test_ungrouped_plan_has_no_join(spark):
    df = spark.range(50).selectExpr("id", "array(cast(id as double), 1D) as embedding")
    out = pair_reduce(df, df, TopK(2), metric="euclidean", same_ids=True, block_rows=8)
    assert "Join" not in out._jdf.queryExecution().toString()
