"""Driver contract: entry, query catalog, oracle keys."""

from __future__ import annotations

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert set(df.columns) == {"id", "prompt", "manifold_distance", "rank"}
    assert df.count() > 0


def test_oracle_keys_subset():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_every_query_builds(spark):
    for name, q in E.queries().items():
        df = q(spark, "/root/testdata/sf0.001")
        assert len(df.columns) > 0, name
