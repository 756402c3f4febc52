"""Structured Streaming.

X1 scores a stream of new vectors against fitted centres or a fixed corpus.  Each
micro-batch is a batch job of the same operators (``nearest_centre``,
``corpus_scores``), so centres or a corpus of any size give the rows that a batch
gives.

X2 measures drift of a per-key profile over time: a watermarked one-day window
aggregate (sums only, so partial aggregation applies) in update mode, whose state
ends with the watermark, then the cosine distance of each day's centre to the key's
previous day (a window over days per key: its group is the number of days, not the
data volume).

Sinks write the rows of an epoch to a folder of its own and overwrite it when the
epoch is repeated after a failure, so no row counts twice.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from embedscope.functions import vectors as V
from embedscope.operators.clusters import CENTRE_BYTES, nearest_centre
from embedscope.operators.scoring import corpus_scores
from embedscope.session import cut_lineage
from embedscope.sources.files import output_dir

def _epochs(job, sink_path: str):
    """A ``foreachBatch`` function: the rows of ``job(batch)`` to the epoch's folder."""
    def write(batch: DataFrame, epoch: int) -> None:
        job(batch).write.mode("overwrite").parquet(f"{sink_path}/epoch={epoch}")
    return write


def _start(rows: DataFrame, job, sink_path: str, checkpoint_path: str, mode: str = "append") -> StreamingQuery:
    return (rows.writeStream.outputMode(mode).foreachBatch(_epochs(job, sink_path))
            .option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start())


def score_stream(spark: SparkSession, stream: DataFrame, centres: DataFrame, sink_path: str,
                 checkpoint_path: str, id_col: str = "id", vec_col: str = "embedding",
                 max_bytes: int = CENTRE_BYTES) -> StreamingQuery:
    """``(id, nearest_label, manifold_distance)`` for each arriving row (label -1
    and +infinity without a defined distance), with ``availableNow``."""
    cents = cut_lineage(centres.select("label", "centre"))

    def job(batch: DataFrame) -> DataFrame:
        near = nearest_centre(cut_lineage(batch), cents, id_col=id_col, vec_col=vec_col, max_bytes=max_bytes)
        return near.select(id_col, F.coalesce("nearest_label", F.lit(-1)).cast("bigint").alias("nearest_label"),
                           F.col("distance").alias("manifold_distance"))

    return _start(stream.select(id_col, vec_col), job, sink_path, checkpoint_path)


def corpus_stream(spark: SparkSession, stream: DataFrame, corpus: DataFrame, sink_path: str, checkpoint_path: str,
                  method: str = "cosine", top_k: int = 5) -> StreamingQuery:
    """The corpus score of each arriving vector ``(id, embedding)`` against a fixed
    corpus ``(id, embedding)``."""
    fixed = cut_lineage(corpus.select("id", "embedding"))
    return _start(stream.select("id", V.as_double("embedding").alias("embedding")),
                  lambda batch: corpus_scores(cut_lineage(batch), fixed, method=method, top_k=top_k),
                  sink_path, checkpoint_path)


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A driver table as a file stream.  It is one file or a folder of part files; the
    pattern matches either by its own name, and of a folder the source lists all files."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    return source.parquet(f"{sf_dir.rstrip('/')}/{name}.parque[t]")


def embeddings_stream(spark: SparkSession, sf_dir: str, where: Column | None = None) -> DataFrame:
    """The driver's embeddings as a file stream of some or all rows, all that have
    arrived in one batch: the whole corpus meets each batch anew."""
    rows = table_stream(spark, sf_dir, "embeddings")
    return ((rows if where is None else rows.where(where))
            .select(F.col("vec_id").alias("id"), "embedding"))


def run_to_table(spark: SparkSession, start, name: str) -> DataFrame:
    """Run a stream to completion (availableNow) and read its sink."""
    sink = output_dir(spark, f"{name}-sink")
    ckpt = output_dir(spark, f"{name}-ckpt")
    q = start(sink, ckpt)
    q.awaitTermination()
    return spark.read.parquet(sink)


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of the rows that epochs wrote for a key, the last ones."""
    rest = [c for c in rows.columns if c not in (*keys, "epoch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("r")).select(*keys, "r.*")


# ---------------------------------------------------------------- drift

def _profile(events: DataFrame) -> DataFrame:
    h = F.hour("ts").cast("double")
    ang = F.lit(2.0 * math.pi / 24.0) * h
    # event time as TIMESTAMP (the files hold zone-less timestamps; the
    # session zone is UTC, so wall-clock hours are unchanged)
    return events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("value").alias("f0"),
                         F.sin(ang).alias("f1"), F.cos(ang).alias("f2"))


def daily_profiles(events: DataFrame, watermark: str | None = None) -> DataFrame:
    """Per key and one-day window: event count and the mean of the profile
    vector ``(value, sin hour, cos hour)``.  Works on batch and stream."""
    p = _profile(events)
    if watermark:
        p = p.withWatermark("ts", watermark)
    agg = p.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("f0").alias("s0"), F.sum("f1").alias("s1"), F.sum("f2").alias("s2"))
    return agg.select("event_type", F.to_date(F.col("w.start")).alias("day"), "n", "s0", "s1", "s2")


def drift(profiles: DataFrame) -> DataFrame:
    """Cosine distance (raw) of each day's centre to the previous day of
    the same key: ``(event_type, day, n, prev_day, drift)``."""
    c = profiles.select("event_type", "day", "n",
                        F.array(F.col("s0") / F.col("n"), F.col("s1") / F.col("n"), F.col("s2") / F.col("n"))
                        .alias("centre"))
    w = Window.partitionBy("event_type").orderBy("day")
    lagged = c.select("event_type", "day", "n", "centre", F.lag("day").over(w).alias("prev_day"),
                      F.lag("centre").over(w).alias("prev"))
    return lagged.select("event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), "n",
                         F.date_format("prev_day", "yyyy-MM-dd").alias("prev_day"),
                         F.when(F.col("prev").isNotNull(), V.cosine_distance_raw("centre", "prev")).alias("drift"))


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_stream(spark, sf_dir, "events").select("ts", "event_type", "value")


def stream_daily_profiles(spark: SparkSession, stream: DataFrame, sink_path: str, checkpoint_path: str,
                          watermark: str = "1 day") -> StreamingQuery:
    """X2 streaming half: watermarked daily profile sums, rows of :func:`latest` by
    ``(event_type, day)``.

    In update mode an epoch emits the keys and days that it changed, the last, still
    open day too; the state of a day ends when the watermark passes it, so it holds the
    days within the watermark only.  Events older than that are dropped.
    """
    return _start(daily_profiles(stream, watermark), lambda batch: batch, sink_path, checkpoint_path, "update")
