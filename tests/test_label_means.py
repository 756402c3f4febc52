"""Distances to labels: each is measured once, for both of its points."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import to_df
from reference_impl import euclid, silhouette


@pytest.mark.parametrize("block", ["0", "60"])
@pytest.mark.parametrize("kind", ["few", "many", "mixed"])
def test_label_means_by_definition(spark, monkeypatch, block, kind):
    """Wide labels, labels whole in a block, and both, in one block and in several."""
    from embedscope.operators import clusters as C
    from embedscope.operators import labelmeans as L
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    labels = {"few": rng.integers(0, 3, 300), "many": rng.integers(0, 90, 300),
              "mixed": np.where(rng.random(300) < 0.5, 0, rng.integers(1, 60, 300))}[kind]
    monkeypatch.setattr(L, "TILE_ROWS", 16)
    monkeypatch.setattr(L, "TILE_COLS", 24)
    spark.conf.set("embedscope.pairs.blockRows", block)
    try:
        for metric, dist in (("euclidean", euclid), ("manhattan", lambda a, b: np.abs(a[:, None] - b[None]).sum(-1))):
            assert C.silhouette(to_df(spark, x, labels), metric=metric).first()[0] == pytest.approx(silhouette(x, labels, dist))
    finally:
        spark.conf.unset("embedscope.pairs.blockRows")


def test_labellings_of_many_labels_have_their_own_pass(spark, monkeypatch):
    from embedscope.operators import clusters as C
    from embedscope.operators import labelmeans as L
    monkeypatch.setattr(L, "WIDE_LABELS", 10)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 3))
    labs = {"a": rng.integers(0, 4, 120), "b": rng.integers(0, 40, 120), "c": np.where(rng.random(120) < 0.3, -1, rng.integers(0, 5, 120))}
    labelled = spark.createDataFrame([(c, i, int(v)) for c, ls in labs.items() for i, v in enumerate(ls)], "config string, id long, label int")
    got = C.silhouette_configs(to_df(spark, x), labelled, list(labs)).groupBy("config").agg(F.avg("s").alias("s"))
    for r in got.collect():
        here = labs[r["config"]] != -1
        assert r["s"] == pytest.approx(silhouette(x[here], labs[r["config"]][here]))


def test_a_tile_measures_its_distances_once(monkeypatch):
    """Both sides of a tile take their sums from one distance block."""
    import pyarrow as pa
    from embedscope.operators import labelmeans as L
    rng = np.random.default_rng(7)
    x, labels = rng.normal(size=(50, 3)), rng.integers(0, 2, 50)

    def side(rows):
        return L._Side(pa.table({
            "id": rows, "embedding": [x[i].tolist() for i in rows], "codes": [[int(labels[i])] for i in rows],
            "label": labels[rows], "size": np.zeros(len(rows), np.int64)}), 2)

    measured = []
    plain = L.pairwise
    monkeypatch.setattr(L, "pairwise", lambda m, a, b: measured.append(len(a) * len(b)) or plain(m, a, b))
    left, right = side(np.arange(20)), side(np.arange(20, 50))
    L._tile(left, right, "manhattan")
    assert sum(measured) == 20 * 30
    d = np.abs(x[:, None] - x[None]).sum(-1)
    for s, others in ((left, range(20, 50)), (right, range(20))):
        for k, i in enumerate(s.id):
            assert np.allclose(s.sums[k], [sum(d[i, j] for j in others if labels[j] == c) for c in (0, 1)])


def test_unit_vectors_bind_their_norm(spark):
    """The norm is summed once for a vector, not for each of its elements."""
    from embedscope.functions import vectors as V
    assert str(V.normalize("v")).count("aggregate") == 1
    df = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, None)], "id int, v array<double>")
    assert [r[0] for r in df.orderBy("id").select(V.normalize("v")).collect()] == [[0.6, 0.8], [0.0, 0.0], None]


def test_cosine_distances_of_columns():
    """The rule of the row-wise expression: missing, zero and odd vectors are at distance 1."""
    import pyarrow as pa
    from embedscope.operators.agreement import _cosine_distances
    a = pa.array([[1.0, 0.0], [0.0, 0.0], None, [1.0, None], [1.0, 2.0, 3.0], [1.0], [], [float("nan"), 1.0], [3.0, 4.0]], pa.list_(pa.float64()))
    b = pa.array([[-2.0, 0.0], [1.0, 0.0], [1.0, 0.0], [1.0, 1.0], [2.0, 4.0, 6.0], [1.0, 1.0], [], [1.0, 1.0], [4.0, 3.0]], pa.list_(pa.float64()))
    assert _cosine_distances(a, b) == pytest.approx([2.0, 1.0, 1.0, 1.0, 0.0, 1.0, 1.0, 2.0, 1 - 24 / 25])


def test_document_tokens(spark, monkeypatch):
    """Every ASCII character: only white space parts tokens; slices of a few bytes give the same vectors."""
    from embedscope.operators import featurize as T
    every = "".join(f"{chr(c)}x{chr(c)}{chr(c)}é" for c in range(1, 128))
    texts = spark.createDataFrame([(i, every[i:] + " a" * i) for i in range(12)] + [(90, None), (91, "  \t")], "id bigint, text string")
    want = {r["id"]: r["embedding"] for r in T.text_embeddings(texts).collect()}
    assert {r["id"]: r["embedding"] for r in T.document_vectors(texts).collect()} == want
    import pyarrow as pa
    monkeypatch.setattr(T, "TEXT_BYTES", 3)
    batch = pa.record_batch([pa.array([0, 1, 2, 3]), pa.array(["ab", None, "c", "long text"])], ["id", "text"])
    assert [s.num_rows for s in T._text_slices(batch)] == [3, 1]
