"""Streams read a table that is one file or a folder of part files."""

from __future__ import annotations

from pyspark.sql import functions as F

from embedscope.plans.catalog import QUERIES


def _embeddings(spark):
    vec = F.array(*[F.cos(F.col("id") * k + k).cast("float") for k in range(1, 5)])
    return spark.range(60).select(F.col("id").alias("vec_id"), vec.alias("embedding"),
                                  (F.col("id") % 10).cast("int").alias("label"))


def test_streams_read_part_files(spark, tmp_path):
    """The tables of the larger sizes are folders."""
    _embeddings(spark).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    streamed = {r.id: r.score for r in QUERIES["stream_corpus_scores"](spark, str(tmp_path)).collect()}
    batch = {r.id: r.score for r in QUERIES["corpus_score_cosine"](spark, str(tmp_path)).collect()}
    assert streamed == batch and len(batch) == 30
    assert QUERIES["stream_manifold_scores"](spark, str(tmp_path)).count() == 60


def test_event_stream_reads_part_files(spark, tmp_path):
    ts = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 3600)
    ev = spark.range(200).select(ts.alias("ts"), F.lit("a").alias("event_type"), F.cos("id").alias("value"))
    ev.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    streamed = sorted(map(tuple, QUERIES["stream_event_drift"](spark, str(tmp_path)).select("event_type", "day", "n").collect()))
    assert streamed == sorted(map(tuple, QUERIES["event_drift"](spark, str(tmp_path)).select("event_type", "day", "n").collect()))
