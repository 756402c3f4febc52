"""Toxicity severity: cumulative-link ordinal regression on sparse text features.

``P(grade > k) = sigmoid(w . x - theta_k)`` with one weight vector ``w`` shared
by all ordered thresholds ``theta_0 < theta_1 < ...``; the expected severity is
the sum of these probabilities.

Features are the distinct lower-cased words of a text and their first four to
six letters, hashed into ``2**bits`` cells with value ``log(1 + count)``: an
abusive stem is caught under any ending.  There is no scaling by length, so one
slur in a long text counts as much as in a short one; the L1 part of the
follow-the-regularised-leader updates keeps ordinary words at zero.

The labels say only whether a text is toxic.  Grades above zero therefore rank
the toxic sample rows by abusive evidence (cells that occur at least
``min_count`` times in toxic rows and hardly ever in others): the lower, middle
and upper third become grades 1, 2 and 3.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from embedscope.llm.quality import ftrl_step, ftrl_weights, sigmoid, trained
from embedscope.llm.work import labelled_sample, table

SAMPLE_ROWS = 16_000
BITS = 20
GRADES = 3
EPOCHS = 4
CACHE_WORDS = 200_000
PREFIXES = (4, 5, 6)

_WORD = re.compile(r"[^\W_]+")
_FTRL = dict(alpha=0.2, beta=1.0, l1=0.3, l2=0.2)


class _Cells(dict):
    """word -> row of ``cells`` (-1: none); emptied between two texts when full."""

    def __init__(self, bits: int):
        self.mask = (1 << bits) - 1
        self.cells = np.empty((1 << 12, 1 + len(PREFIXES)), np.int32)

    def __missing__(self, word: str) -> int:
        i = len(self)
        if i >= len(self.cells):
            self.cells = np.concatenate([self.cells, self.cells])
        self.cells[i] = [xxh3_64_intdigest(word, 11) & self.mask, *[
            xxh3_64_intdigest(word[:n], 12) & self.mask if len(word) >= n else -1 for n in PREFIXES]]
        self[word] = i
        return i


def features(text: str, cache: _Cells) -> tuple[np.ndarray, np.ndarray]:
    if len(cache) > CACHE_WORDS:
        cache.clear()
    words = _WORD.findall(text.lower())
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    rows, times = np.unique(np.fromiter(map(cache.__getitem__, words), np.int64, len(words)), return_counts=True)
    cells = cache.cells[rows]
    times = np.broadcast_to(np.minimum(times, 3)[:, None], cells.shape)
    there = cells >= 0
    idx, at = np.unique(cells[there], return_inverse=True)
    return idx, np.log1p(np.bincount(at, times[there])).astype(np.float32)


def grade(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int, grades: int = GRADES,
          min_count: int = 3) -> np.ndarray:
    """Ordered targets 0..grades from 0/1 labels, see the module text."""
    seen = np.zeros((2, 1 << bits), np.int32)
    for idx, _, y in rows:
        seen[y, idx] += 1
    strong = (seen[1] >= min_count) & (seen[1] > 20 * seen[0])
    evidence = np.array([x[strong[idx]].sum() if y else 0.0 for idx, x, y in rows])
    toxic = np.array([y for _, _, y in rows], bool)
    out = np.zeros(len(rows), np.int64)
    if toxic.any():
        cuts = np.quantile(evidence[toxic], [k / grades for k in range(1, grades)])
        out[toxic] = 1 + np.searchsorted(cuts, evidence[toxic], side="left")
    return out


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], targets: np.ndarray, bits: int = BITS,
          grades: int = GRADES, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and ordered thresholds by sequential updates.

    The thresholds are a first value and positive gaps, so they stay ordered.
    """
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    par = np.concatenate([[2.0], np.zeros(grades - 1)])  # first threshold, logs of the gaps
    acc = np.ones(grades)
    for _ in range(epochs):
        for (idx, x, _), y in zip(rows, targets):
            gaps = np.exp(par[1:])
            theta = par[0] + np.concatenate([[0.0], np.cumsum(gaps)])
            slope = np.zeros(grades)

            def loss_slope(m, y=y, theta=theta, slope=slope):
                lo = sigmoid(theta[y - 1] - m) if y > 0 else 0.0
                hi = sigmoid(theta[y] - m) if y < grades else 1.0
                p = max(hi - lo, 1e-12)
                if y < grades:
                    slope[y] -= hi * (1 - hi) / p
                if y > 0:
                    slope[y - 1] += lo * (1 - lo) / p
                return 1.0 - lo - hi

            if len(idx):
                ftrl_step(z, n, idx, x, loss_slope, **_FTRL)
            else:
                loss_slope(0.0)
            g = np.concatenate([[slope.sum()], [slope[k:].sum() * gaps[k - 1] for k in range(1, grades)]])
            acc += g * g
            par -= 0.5 * g / np.sqrt(acc)
    theta = par[0] + np.concatenate([[0.0], np.cumsum(np.exp(par[1:]))])
    return ftrl_weights(z, n, **_FTRL), theta


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, bits: int = BITS):
    """Weights and thresholds from at most ``sample_rows`` labelled documents;
    features and the sequential updates are made on the executors."""
    sample = labelled_sample(docs, labels, {"y": (F.col("toxic") > 0).cast("int")}, sample_rows)

    def run(batches):
        cache = _Cells(bits)
        for b in batches:
            cells = [features(t or "", cache) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("y"), pa.array([c.tobytes() for c, _ in cells], pa.binary()),
                 pa.array([v.tobytes() for _, v in cells], pa.binary())], ["doc_id", "y", "cells", "vals"])

    made = (sample.select(F.col("doc_id").cast("long").alias("doc_id"), "y", "text")
            .mapInArrow(run, "doc_id long, y int, cells binary, vals binary"))
    return trained(made, lambda rows: train(rows, grade(rows, bits), bits))


def score(docs: DataFrame, weights: np.ndarray, theta: np.ndarray, bits: int = BITS) -> DataFrame:
    """``(doc_id, expected_severity, p_ge_1.., grade, toxic)`` per row.

    ``toxic`` is ``p_ge_1 >= 0.5``; ``grade`` counts the thresholds passed with
    probability 0.5 or more.  Empty and null texts have no cells and score by
    the thresholds alone; repeated rows score alike; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast((weights, theta))  # 2**bits floats
    frame = docs.select("doc_id", "text")
    names = [f"p_ge_{k + 1}" for k in range(len(theta))]
    schema = frame.drop("text").schema.add("margin", "double")

    def run(batches):
        cache, (w, _) = _Cells(bits), shared.value
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                idx, x = features(t or "", cache)
                out.append(float(w[idx].astype(np.float64) @ x))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.float64())],
                                             ["doc_id", "margin"])

    p = frame.mapInArrow(run, schema).select(
        "doc_id", *[(1 / (1 + F.exp(F.lit(float(t)) - F.col("margin")))).alias(n)
                    for n, t in zip(names, theta)])
    return p.select("doc_id", sum((F.col(n) for n in names), F.lit(0.0)).alias("expected_severity"), *names,
                    sum((F.when(F.col(n) >= 0.5, 1).otherwise(0) for n in names), F.lit(0)).alias("grade"),
                    (F.col(names[0]) >= 0.5).alias("toxic"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, *fit(docs, table(spark, sf_dir, "labels")))
