"""Shared Spark session and fixtures (shapes follow FIXTURES.md)."""

from __future__ import annotations

import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from embedscope.session import build_session
    s = build_session(master="local[4]", app="embedscope-tests", shuffle_partitions=8)
    yield s
    s.stop()


def planted_clusters(seed=42, n_clusters=3, size=10, noise=5, dim=2, sd=0.1):
    """Three tight normal clusters plus uniform noise points."""
    rng = np.random.default_rng(seed)
    centres = np.array([[1.0, 1.0], [-1.0, -1.0], [0.0, 2.0]])[:n_clusters]
    if dim != 2:
        centres = rng.uniform(-2, 2, size=(n_clusters, dim))
    pts = [c + rng.normal(0, sd, size=(size, dim)) for c in centres]
    pts.append(rng.uniform(-2, 2, size=(noise, dim)))
    return np.vstack(pts)


def to_df(spark, mat, labels=None, ids=None, extra=None):
    ids = list(range(len(mat))) if ids is None else list(ids)
    rows = []
    for k, (i, v) in enumerate(zip(ids, mat)):
        r = {"id": int(i), "embedding": [float(x) for x in v]}
        if labels is not None:
            r["label"] = int(labels[k])
        if extra:
            for name, col in extra.items():
                r[name] = col[k]
        rows.append(r)
    schema = "id bigint, embedding array<double>"
    if labels is not None:
        schema += ", label int"
    if extra:
        for name, col in extra.items():
            schema += f", {name} {'bigint' if isinstance(col[0], (int, np.integer)) else 'string'}"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def sample(spark):
    """35 x 2: three clusters of 10 plus 5 noise points, given labels."""
    x = planted_clusters()
    labels = np.array([0] * 10 + [1] * 10 + [2] * 10 + [-1] * 5)
    return x, labels, to_df(spark, x, labels)
