"""HDBSCAN (M6), text featurisers (E1-E3), streaming (X1/X2), MLlib (M1-M9)."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import planted_clusters, to_df
from reference_impl import cos_lib, hdbscan as bf_hdbscan, same_partition


def test_hdbscan_separated_clusters(spark):
    """Three well separated blobs of 12: recovered exactly, no noise."""
    rng = np.random.default_rng(0)
    centres = np.array([[0.0, 0.0], [10.0, 0.0], [0.0, 10.0]])
    x = np.vstack([c + rng.normal(0, 0.2, size=(12, 2)) for c in centres])
    truth = np.repeat([0, 1, 2], 12)
    from embedscope.operators.hdbscan import hdbscan
    labels, clusters = hdbscan(to_df(spark, x), min_cluster_size=5, min_samples=3)
    got = dict((r["id"], r["label"]) for r in labels.collect())
    assert same_partition([got[i] for i in range(len(x))], truth)
    assert clusters.where("selected").count() == 3


def test_hdbscan_needs_two_points(spark):
    from embedscope.operators.hdbscan import hdbscan
    with pytest.raises(ValueError):
        hdbscan(to_df(spark, np.ones((1, 2))))


@pytest.mark.parametrize("kind,band,block", [("cloud", 7, None), ("cloud", 1 << 18, 24), ("grid", 5, None), ("grid", 1 << 18, 24)])
def test_hdbscan_matches_definition(spark, kind, band, block):
    """Any band size, several balls, many tied weights included, gives the textbook result."""
    from embedscope.operators.hdbscan import hdbscan
    rng = np.random.default_rng(4)
    if kind == "cloud":
        x = planted_clusters(size=12, noise=12, sd=0.25)
    else:  # integer places, some repeated: most weights are ties
        x = rng.integers(0, 9, size=(60, 2)).astype(float)
    few = {"block_rows": block, "tree_points": 0} if block else {}
    labels, clusters = hdbscan(to_df(spark, x), 4, 2, band_edges=band, **few)
    got = {r["id"]: r["label"] for r in labels.collect()}
    want, n_clusters = bf_hdbscan(x, 4, 2)
    assert [got[i] for i in range(len(x))] == want
    assert clusters.count() == n_clusters


def test_hashed_text_embedding(spark):
    from embedscope.operators.featurize import hashed_embedding, text_embeddings
    texts = spark.createDataFrame([(1, "a b  a\nc"), (2, ""), (3, "x")], "id bigint, text string")
    sp = {(r["id"], r["bucket"]): r for r in hashed_embedding(texts).collect()}
    assert sum(r["weight"] for k, r in sp.items() if k[0] == 1) == pytest.approx(1.0)
    assert all(r["n_tokens"] == 4 for k, r in sp.items() if k[0] == 1)
    dense = {r["id"]: r["embedding"] for r in text_embeddings(texts).collect()}
    assert len(dense) == 3 and sum(dense[2]) == 0.0 and sum(dense[3]) == pytest.approx(1.0)


def test_document_vectors_equal_text_embeddings(spark):
    from embedscope.operators.featurize import document_vectors, text_embeddings
    texts = spark.createDataFrame([(1, "a b  a\nc d"), (2, ""), (3, "x"), (4, None), (5, " \t é é ")], "id bigint, text string")
    want = {r["id"]: r["embedding"] for r in text_embeddings(texts).collect()}
    got = {r["id"]: r["embedding"] for r in document_vectors(texts).collect()}
    assert got == want and len(got) == 5
    parts = {(r["id"], r["response_id"]): sum(r["embedding"]) for r in document_vectors(texts, parts=3).collect()}
    assert parts == {(1, 0): 1.0, (1, 1): 1.0, (1, 2): 1.0, (3, 0): 1.0, (5, 0): 1.0, (5, 1): 1.0}


def test_stream_scores_equal_batch(spark):
    from embedscope.operators import clusters as C
    from embedscope.sources import tables as T
    from embedscope.streaming.stream import embeddings_stream, run_to_table, score_stream
    sf = "/root/testdata/sf0.001"
    v = T.vectors(spark, sf)
    cents = C.centres(v)
    streamed = run_to_table(spark, lambda s, c: score_stream(spark, embeddings_stream(spark, sf), cents, s, c), "t")
    # centres above the bound meet the rows in the pair kernel: the same rows
    kernel = run_to_table(spark, lambda s, c: score_stream(spark, embeddings_stream(spark, sf), cents, s, c,
                                                           max_bytes=0), "t0")
    assert {(r["id"], r["nearest_label"]) for r in kernel.collect()} == \
        {(r["id"], r["nearest_label"]) for r in streamed.collect()}
    batch = C.ManifoldModel(cents).distances(v.select("id", "embedding"))
    j = streamed.join(batch.withColumnRenamed("manifold_distance", "b"), "id")
    assert j.count() == v.count()
    assert j.agg(F.max(F.abs(F.col("manifold_distance") - F.col("b")))).first()[0] < 1e-9


def test_kmeans_recovers_planted(spark):
    from embedscope.operators.mlmodels import kmeans, pca_2d
    x = planted_clusters(noise=0, sd=0.05)
    labels, cents = kmeans(to_df(spark, x), 3)
    got = dict((r["id"], r["label"]) for r in labels.collect())
    assert same_partition([got[i] for i in range(30)], np.repeat([0, 1, 2], 10))
    assert pca_2d(to_df(spark, planted_clusters(dim=5))).count() == 35


def test_tournament_sweeps_k(spark):
    """Three blobs: k = 3 wins although the given k is 2; scores by definition."""
    from embedscope.operators.mlmodels import tournament
    x = planted_clusters(noise=0, sd=0.05)
    rows = {r["config"]: r for r in tournament(to_df(spark, x), 2, 0.5).collect()}
    assert set(rows) == {"dbscan", *(f"{m}_{k}" for m in ("kmeans", "gmm", "agglomerative") for k in (2, 3, 4, 5))}
    assert [c for c, r in rows.items() if r["best"]] == ["kmeans_3"] and rows["dbscan"]["k"] is None
    truth = np.repeat([0, 1, 2], 10)
    mean = np.array([x[truth == c].mean(axis=0) for c in range(3)])
    between = 10 * ((mean - x.mean(axis=0)) ** 2).sum() / 2
    within = ((x - mean[truth]) ** 2).sum() / 27
    assert rows["kmeans_3"]["calinski_harabasz"] == pytest.approx(between / within)
    assert rows["dbscan"]["calinski_harabasz"] == pytest.approx(between / within)
    assert rows["kmeans_3"]["silhouette"] > max(rows["kmeans_2"]["silhouette"], rows["kmeans_4"]["silhouette"])


def test_pipeline_needs_responses(spark):
    from embedscope.plans.pipeline import run_full_pipeline
    prompts = spark.createDataFrame([(0, "a"), (1, "b")], "id bigint, prompt string")
    with pytest.raises(ValueError, match="responses"):
        run_full_pipeline(to_df(spark, np.eye(2)), prompts)


def test_consistency_single_response_is_null(spark):
    from embedscope.operators.consistency import batch_statistics, prompt_consistency
    rows = [(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 0, [1.0, 1.0])]
    resp = spark.createDataFrame(rows, "id bigint, response_id bigint, embedding array<double>")
    prompts = spark.createDataFrame([(1, "p1"), (2, "p2"), (3, "p3")], "id bigint, prompt string")
    out = {r["id"]: r for r in prompt_consistency(prompts, resp).collect()}
    assert out[1]["mean_pairwise_distance"] == pytest.approx(1.0)
    assert out[2]["consistency_score"] is None and out[3]["n_responses"] == 0
    # orthogonal responses give consistency 0.0; missing scores sort as 0:
    # a three-way tie, ranked in id order
    assert [out[i]["rank"] for i in (1, 2, 3)] == [1, 2, 3]
    b = batch_statistics(prompt_consistency(prompts, resp)).first()
    assert b["n_prompts"] == 3 and b["mean_consistency"] == pytest.approx(0.0)


def test_fusion_weights_present_scores_only(spark):
    from embedscope.operators.fusion import combine_scores
    prompts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id bigint, prompt string")
    man = spark.createDataFrame([("a", 0.2), ("a", 0.6), ("b", 0.1)], "prompt string, manifold_distance double")
    con = spark.createDataFrame([("a", 0.9)], "prompt string, consistency_score double")
    out = {r["id"]: r for r in combine_scores(prompts, man, con).collect()}
    # repeated text takes the worst value; weights of absent scores are dropped
    assert out[1]["combined_score"] == pytest.approx((0.4 * 0.6 + 0.3 * 0.1) / 0.7)
    assert out[2]["combined_score"] == pytest.approx(0.1)
    assert out[1]["rank"] == 1 and out[3]["rank"] == 2


def test_stream_state_ends(spark, tmp_path):
    """Days that the watermark has passed leave the state; events older than it are dropped."""
    from embedscope.streaming.stream import daily_profiles, latest, stream_daily_profiles
    days = [[1, 1, 2], [4, 5], [8], [9, 1]]  # the last of day 1 comes long after its day has ended
    for k, ds in enumerate(days):
        spark.createDataFrame([(f"2024-01-{d:02d} 10:00:00", "a", float(d)) for d in ds], "t string, event_type string, value double") \
            .select(F.col("t").cast("timestamp").alias("ts"), "event_type", "value").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    schema = "ts timestamp, event_type string, value double"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true") \
        .parquet(f"{tmp_path}/in")
    q = stream_daily_profiles(spark, stream, f"{tmp_path}/sink", f"{tmp_path}/ck")
    q.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(states) <= 4 and states[-1] <= 2
    got = {str(r["day"]): r["n"] for r in latest(spark.read.parquet(f"{tmp_path}/sink"), ["event_type", "day"]).collect()}
    assert got == {"2024-01-01": 2, "2024-01-02": 1, "2024-01-04": 1, "2024-01-05": 1, "2024-01-08": 1, "2024-01-09": 1}
    whole = daily_profiles(spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"))
    assert whole.where("day = '2024-01-01'").first()["n"] == 3
