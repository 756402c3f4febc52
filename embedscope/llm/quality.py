"""Quality classifier: logistic regression over hashed word n-grams, trained
with follow-the-regularised-leader updates, scored as sparse dot products.

Two streams of words feed the n-grams: the words themselves (runs of letters
and digits, runs of one punctuation sign) and their *shapes* (case pattern, the
sign itself, a mark for a word that repeats the one before it, a mark for a line
seen before in the document).  Unigrams and bigrams of the words and unigrams
to trigrams of the shapes are hashed into ``2**bits`` cells; a cell's value is
``log(1 + count)``, scaled to unit length per document and stream.

Training reads a bounded sample of labelled rows (``sample_rows``, a
parameter); scoring reads every whole text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from embedscope.llm.encode import forget
from embedscope.llm.work import labelled_sample, release_memory, slices

SAMPLE_ROWS = 12_000
BITS = 20
EPOCHS = 3
CACHE_WORDS = 300_000

_WORD = re.compile(r"[^\W_]+|[^\w\s]+|_+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


def _shape(word: str) -> str:
    if word[0].isdigit():
        return "9"
    if not word[0].isalpha():
        return word[:3]
    if word.islower():
        return "a"
    if len(word) > 1 and word.isupper():
        return "AA"
    return "Aa" if word[0].isupper() else "aA"


class _Hashes(dict):
    """word -> row of ``word_hash`` and ``shape_hash``; emptied between two texts
    when full."""

    def __init__(self):
        self.word_hash = np.empty(1 << 12, np.uint64)
        self.shape_hash = np.empty(1 << 12, np.uint64)

    def __missing__(self, word: str) -> int:
        i = len(self)
        if i >= len(self.word_hash):
            self.word_hash = np.concatenate([self.word_hash, self.word_hash])
            self.shape_hash = np.concatenate([self.shape_hash, self.shape_hash])
        self.word_hash[i] = xxh3_64_intdigest(word.lower(), 1)
        self.shape_hash[i] = xxh3_64_intdigest(_shape(word), 2)
        self[word] = i
        return i

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > CACHE_WORDS:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.word_hash[at], self.shape_hash[at]


_REPEAT = np.uint64(xxh3_64_intdigest("repeat", 3))
_LINE = np.uint64(xxh3_64_intdigest("line", 3))


def _grams(h: np.ndarray, orders: tuple[int, ...], seed: int) -> np.ndarray:
    parts = []
    for n in orders:
        if len(h) < n:
            continue
        g = h[: len(h) - n + 1] + np.uint64(seed + n)
        for k in range(1, n):
            g = (g ^ (g >> np.uint64(29))) * _MIX + h[k: len(h) - n + 1 + k] * _MIX2
        parts.append(g)
    if not parts:
        return np.empty(0, np.uint64)
    g = np.concatenate(parts)
    g = (g ^ (g >> np.uint64(31))) * _MIX2
    return g ^ (g >> np.uint64(29))


def features(text: str, cache: _Hashes, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells (int32) and values (float32) of one whole text."""
    words = _WORD.findall(text)
    if not words:
        return np.zeros(1, np.int32), np.ones(1, np.float32)
    h, s = cache.of(words)
    s[1:][h[1:] == h[:-1]] = _REPEAT
    lines = [x for x in text.split("\n") if len(x) > 1]
    again = len(lines) - len(set(lines))
    if again:
        s = np.concatenate([s, np.full(again, _LINE)])
    mask = np.uint64((1 << (bits - 1)) - 1)
    idx, val = [np.zeros(1, np.int64)], [np.ones(1)]
    for offset, g in ((0, _grams(h, (1, 2), 10)), (1 << (bits - 1), _grams(s, (1, 2, 3), 20))):
        cells, counts = np.unique((g & mask).astype(np.int64) | offset, return_counts=True)
        if len(cells) and cells[0] == 0:  # cell 0 is the constant
            cells, counts = cells[1:], counts[1:]
        if len(cells):
            v = np.log1p(counts)
            idx.append(cells)
            val.append(v / np.sqrt((v * v).sum()))
    return np.concatenate(idx).astype(np.int32), np.concatenate(val).astype(np.float32)


def ftrl_step(z, n, idx, x, grad_of, alpha, beta, l1, l2):
    """One follow-the-regularised-leader update; ``grad_of(margin)`` is the
    derivative of the loss with respect to the margin.  Returns the margin."""
    zi, ni = z[idx], n[idx]
    w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2)
    w[np.abs(zi) <= l1] = 0.0
    margin = float(w @ x)
    g = grad_of(margin) * x
    n_new = ni + g * g
    z[idx] = zi + g - (np.sqrt(n_new) - np.sqrt(ni)) / alpha * w
    n[idx] = n_new
    return margin


def ftrl_weights(z, n, alpha, beta, l1, l2) -> np.ndarray:
    w = -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2)
    w[np.abs(z) <= l1] = 0.0
    return w.astype(np.float32)


def sigmoid(m: float) -> float:
    return 1.0 / (1.0 + np.exp(-min(max(m, -35.0), 35.0)))


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS,
               alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 0.5) -> np.ndarray:
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    for _ in range(epochs):
        for idx, x, y in rows:
            ftrl_step(z, n, idx, x, lambda m, y=y: sigmoid(m) - y, alpha, beta, l1, l2)
    return ftrl_weights(z, n, alpha, beta, l1, l2)


def _featurise(bits: int):
    def run(batches):
        forget()
        cache = _Hashes()
        b = cells = None
        for b in slices(batches, "text"):
            cells = [features(t or "", cache, bits) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("y"), pa.array([c.tobytes() for c, _ in cells], pa.binary()),
                 pa.array([v.tobytes() for _, v in cells], pa.binary())], ["doc_id", "y", "cells", "vals"])
        del cache, b, cells
        release_memory()
    return run


def trained(sample: DataFrame, learn) -> list[np.ndarray]:
    """The arrays that ``learn(rows)`` makes of a bounded sample's sparse rows
    ``(cells, vals, y)``, given in an order that only the ids decide.

    The updates are sequential, so they run in one task, whose input is the
    sample's bound at most; the driver receives the arrays alone.
    """

    def run(batches):
        forget()
        rows = []
        for b in batches:
            rows += zip(map(str, b.column("doc_id").to_pylist()), b.column("y").to_pylist(),
                        b.column("cells").to_pylist(), b.column("vals").to_pylist())
        rows.sort(key=lambda r: (xxh3_64_intdigest(r[0]), r[1]))
        made = learn([(np.frombuffer(c, np.int32), np.frombuffer(v, np.float32), y) for _, y, c, v in rows])
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(made)), pa.int32()), pa.array([m.dtype.str for m in made]),
             pa.array([m.tobytes() for m in made], pa.binary())], ["part", "kind", "data"])
        del rows, made
        release_memory()

    parts = sample.repartition(1).mapInArrow(run, "part int, kind string, data binary").collect()
    if not parts:  # an empty plan runs no task
        return list(learn([]))
    return [np.frombuffer(bytes(r.data), r.kind) for r in sorted(parts, key=lambda r: r.part)]


def fit(docs: DataFrame, labels: DataFrame, where=None, sample_rows: int = SAMPLE_ROWS,
        bits: int = BITS) -> np.ndarray:
    """Weights (``2**bits`` floats) from at most ``sample_rows`` labelled documents.

    Both the sample's features and the updates are made on the executors.
    """
    sample = labelled_sample(docs, labels, {"y": F.col("quality").cast("int")}, sample_rows, where)
    sample = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "y", "text")
    made = sample.mapInArrow(_featurise(bits), "doc_id long, y int, cells binary, vals binary")
    return trained(made, lambda rows: [train_ftrl(rows, bits)])[0]


def score(docs: DataFrame, weights: np.ndarray, keep: list[str], bits: int = BITS,
          text: str = "text") -> DataFrame:
    """``keep`` columns plus ``score``: sigmoid of the sparse dot product of
    every row's whole text.  A null text is scored as the empty one."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(weights)  # 2**bits floats, whatever the input
    frame = docs.select(*keep, F.col(text).alias("__text"))
    schema = frame.drop("__text").schema

    def run(batches):
        forget()
        cache, w, b = _Hashes(), shared.value, None
        for b in slices(batches, "__text"):
            out = []
            for t in b.column("__text").to_pylist():
                idx, x = features(t or "", cache, bits)
                out.append(sigmoid(float(w[idx].astype(np.float64) @ x)))
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in keep] + [pa.array(out, pa.float64())], [*keep, "score"])
        del cache, b
        release_memory()

    return frame.mapInArrow(run, schema.add("score", "double"))


def held_out():
    """Rows that no model sees in training: crc32 of the id's text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    Learns only from rows outside the held-out third.  Empty and null texts
    have only the constant cell; repeated rows score alike; a null id is not
    held out; other columns are not read.  With no usable label the weights
    are zero and every score is 0.5.
    """
    crc = F.crc32(F.col("__id").cast("string").cast("binary")) % 3
    weights = fit(docs, labels, where=crc != 1, sample_rows=sample_rows)
    scored = score(docs, weights, ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS,
              threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, columns unchanged.

    The whole row travels through the scoring task as one struct, so no second
    pass and no join is needed.
    """
    weights = fit(docs, labels, sample_rows=sample_rows)
    names = docs.columns
    frame = docs.select(F.struct("*").alias("__doc"), F.col("text").alias("__body"))
    return score(frame, weights, ["__doc"], text="__body").where(F.col("score") >= threshold) \
        .select(*[F.col("__doc")[n].alias(n) for n in names])


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from embedscope.llm.work import table
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
