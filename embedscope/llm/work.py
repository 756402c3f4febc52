"""Helpers shared by the training-data operators: tables, written cuts, row
keys and bounded label samples.

A *cut* is a Parquet table written to the shared folder that the cluster names
in ``spark.checkpoint.dir`` and read back.  It survives lost executors, cuts the
lineage of iterative jobs, and makes ``monotonically_increasing_id`` safe to use
as a key from then on.
"""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from embedscope.session import ensure_checkpoint_dir
from embedscope.sources.tables import table

__all__ = ["table", "Cuts", "labelled_sample", "row_keyed", "shared_dir", "delete_path", "release_memory",
           "slices"]

SLICE_BYTES = 4 << 20


def release_memory() -> None:
    """Gives the memory that this process has freed back to the system, where the
    C library has a call for it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches, column: str, bound: int = SLICE_BYTES):
    """All rows of ``batches`` in their order, in runs whose texts in ``column`` have
    at most ``bound`` bytes and one row's more: what a task makes of a run is then
    small, however large Spark's batches are."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column).cast(pa.large_string())), 0)
        run = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64) // bound
        ends = [*(np.flatnonzero(np.diff(run)) + 1).tolist(), b.num_rows]
        for lo, hi in zip([0, *ends], ends):
            yield b.slice(lo, hi - lo)


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the session's checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str, at_exit: bool = False) -> None:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if at_exit:
        fs.deleteOnExit(hpath)
    else:
        fs.delete(hpath, True)


class Cuts:
    """Tables written for one operator call.

    ``cut`` writes and rereads a frame; ``drop`` deletes a table that no later
    step reads.  What the returned result still reads is deleted when the
    session's JVM ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = shared_dir(spark)
        self._made: dict[int, str] = {}
        delete_path(spark, self.base, at_exit=True)

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._made[id(out)] = path
        out._cut_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = getattr(df, "_cut_path", None)
            if path:
                delete_path(self.spark, path)


def row_keyed(df: DataFrame, cuts: Cuts) -> DataFrame:
    """``(__doc struct of all columns, __file, __row)``: rows with a key that is
    the same in every evaluation.

    Files read by Spark know each row's file and position; any other frame, and
    one with a column named like that knowledge, is written first with a number
    a row.  The columns travel inside one struct, so no name of theirs can clash
    with a helper column.
    """
    if "_metadata" not in map(str.lower, df.columns):
        try:
            keyed = df.select(F.struct("*").alias("__doc"),
                              F.col("_metadata.file_path").alias("__file"),
                              F.col("_metadata.row_index").alias("__row"))
            keyed.schema  # resolves now
            return keyed
        except Exception as e:  # no file source: the metadata column does not resolve
            if "_metadata" not in str(e):
                raise
    return cuts.cut(df.select(F.struct("*").alias("__doc"), F.lit("").alias("__file"),
                              F.monotonically_increasing_id().alias("__row")))


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: dict[str, Column], bound: int,
                    where: Column | None = None) -> DataFrame:
    """At most ``bound`` labelled documents, ``(doc_id, text, *columns)``.

    ``bound`` is the documented size of a training sample: the labelled ids
    with the smallest hashes.  Of repeated label rows the largest values hold;
    of repeated documents the smallest text.  Rows with a null id or a null in
    one of ``columns`` are no labels.
    """
    lab = labels.select(F.col("doc_id").alias("__id"), *[c.alias(n) for n, c in columns.items()])
    lab = lab.dropna()
    if where is not None:
        lab = lab.where(where)
    ids = (lab.groupBy("__id").agg(*[F.max(n).alias(n) for n in columns])
           .orderBy(F.xxhash64("__id"), "__id").limit(bound))
    # at most `bound` rows of a few bytes: the bound of this broadcast
    hit = docs.select(F.col("doc_id"), F.col("text")).join(
        F.broadcast(ids), F.col("doc_id") == F.col("__id"))
    return hit.groupBy("doc_id", *columns).agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
