"""Document fingerprints from prefix polynomial hashes.

A text's *prefix array* holds, for every position, the polynomial hash of all
code points before it, modulo a Mersenne prime and for two bases.  With it

* the hash of any span is two reads and a product, so any two spans of any two
  texts are compared in constant time (``span``, ``same_span``);
* the longest common extension of two positions, forwards or backwards, is found
  by binary search over span lengths (``extend_right``, ``extend_left``);
* the array of a concatenation follows from those of its parts (``joined``).

A fingerprint is the text's length, the hash of its longest span (all of it) and
a sketch: of the hashes of all spans of ``WIDTH`` code points (shorter ones at
the text's start; repeats of a span are numbered) the smallest in each of
``SLOTS`` ranges.  Two sketches agree in a share of their filled slots that
estimates the Jaccard similarity ``J`` of the bags of spans (a slot shows one byte,
so chance agreements are deducted); ``likeness`` gives ``2 J / (1 + J)``, the share of spans that two
texts of one length have in common.

Two hashes of 31 bits decide: different spans are taken for equal with a
probability of about length / 2 ** 61, which an adversary who knows the bases
could raise.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from embedscope.llm.work import Cuts, table

_PRIME = (1 << 31) - 1
PRIME = np.uint64(_PRIME)
BASES = (1_000_003, 1_664_525_111)
WIDTH = 16
SLOTS = 128  # a power of two
PART_TEXT_BYTES = 16 << 20

_SHIFT = np.uint64(31)
_SLOT_BITS = np.uint64(64 - SLOTS.bit_length() + 1)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_SLOT_VALUES = np.uint64(255)


def _mod(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the Mersenne prime, for ``x`` below 2 ** 62."""
    x = (x & PRIME) + (x >> _SHIFT)
    return np.minimum(x, x - PRIME)  # below the prime, the difference wraps round


class _Powers:
    """Powers of a base and of its inverse, grown by doubling."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, _PRIME)
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> "_Powers":
        while len(self.up) < n:
            k = len(self.up)
            for name, b in (("up", self.base), ("down", self.inverse)):
                have = getattr(self, name)
                step = np.uint64(pow(b, k, _PRIME))
                setattr(self, name, np.concatenate([have, _mod(have * step)]))
        return self


_POWERS = [_Powers(b) for b in BASES]


class Prefixes:
    """The prefix arrays of one text; positions count code points."""

    def __init__(self, arrays: list[np.ndarray]):
        self.arrays = arrays
        self.n = len(arrays[0]) - 1

    @classmethod
    def of(cls, text: str) -> "Prefixes":
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
        arrays = []
        for p in _POWERS:
            p.reach(len(codes) + 1)
            # sums of fewer than 2 ** 33 numbers below 2 ** 31 stay below 2 ** 64
            sums = np.cumsum(_mod(codes * p.down[:len(codes)])) % PRIME
            arrays.append(np.concatenate([np.zeros(1, np.uint64), _mod(sums * p.up[:len(codes)])]))
        return cls(arrays)

    def joined(self, head: int, other: "Prefixes", tail: int) -> "Prefixes":
        """The arrays of this text's first ``head`` code points followed by the
        first ``tail`` of the other."""
        arrays = []
        for a, b, p in zip(self.arrays, other.arrays, _POWERS):
            up = p.reach(tail + 1).up[1:tail + 1]
            arrays.append(np.concatenate([a[:head + 1], _mod(_mod(a[head] * up) + b[1:tail + 1])]))
        return Prefixes(arrays)

    def span(self, start, end) -> np.ndarray:
        """Hashes (62 bits) of the spans from ``start`` to before ``end``, numbers or arrays."""
        start, end = np.asarray(start), np.asarray(end)
        parts = [_mod(a[end] + PRIME - _mod(a[start] * p.up[end - start]))
                 for a, p in zip(self.arrays, _POWERS)]
        return parts[0] << _SHIFT | parts[1]

    def same_span(self, start: int, other: "Prefixes", at: int, length: int) -> bool:
        for a, b, p in zip(self.arrays, other.arrays, _POWERS):
            up = p.up.item(length)
            if (a.item(start + length) - a.item(start) * up - b.item(at + length) + b.item(at) * up) % _PRIME:
                return False
        return True

    def whole(self) -> int:
        high, low = (a.item(self.n) for a in self.arrays)
        return high << 31 | low

    @staticmethod
    def _longest(limit: int, same) -> int:
        """Largest length up to ``limit`` for which ``same`` holds: doubling, then binary search."""
        low, high = 0, 1
        while high <= limit and same(high):
            low, high = high, 2 * high
        high = min(high - 1, limit)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if same(mid) else (low, mid - 1)
        return low

    def extend_right(self, start: int, other: "Prefixes", at: int) -> int:
        """Length of the longest common extension from both positions on."""
        return self._longest(min(self.n - start, other.n - at), lambda k: self.same_span(start, other, at, k))

    def extend_left(self, end: int, other: "Prefixes", at: int) -> int:
        """Length of the longest common extension backwards from before both positions."""
        return self._longest(min(end, at), lambda k: self.same_span(end - k, other, at - k, k))


def _numbered(x: np.ndarray) -> np.ndarray:
    """Which occurrence of its value (from 0) each element is."""
    order = np.argsort(x, kind="stable")
    s = x[order]
    new = np.empty(len(x), bool)
    new[:1] = True
    np.not_equal(s[1:], s[:-1], out=new[1:])
    if new.all():
        return np.zeros(len(x), np.uint64)
    at = np.arange(len(x))
    out = np.empty(len(x), np.uint64)
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


def span_hashes(prefixes: Prefixes, first: int, width: int = WIDTH) -> np.ndarray:
    """Hashes of the spans of ``width`` code points (shorter ones at the start)
    that end at position ``first`` (from 1) or later."""
    n = prefixes.n
    ends = np.arange(first, n + 1)
    starts = np.maximum(ends - width, 0)
    # spans of other lengths have other seeds
    return prefixes.span(starts, ends) + np.uint64(0x9E3779B97F4A7C15) * (ends - starts).astype(np.uint64)


def _numbered_hashes(x: np.ndarray) -> np.ndarray:
    return x + _numbered(x) * np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch(x: np.ndarray) -> np.ndarray:
    """Smallest mixed hash in each slot."""
    best = np.full(SLOTS, _NONE)
    x = _mixed(x)
    np.minimum.at(best, (x >> _SLOT_BITS).astype(np.int64), x)
    return best


def fingerprint(prefixes: Prefixes, slots: np.ndarray) -> bytes:
    """Length (8 bytes), hash (8 bytes) and a byte a slot, 0 for an empty one;
    equal texts have equal fingerprints."""
    shown = (slots % _SLOT_VALUES).astype(np.uint8) + np.uint8(1)
    shown[slots == _NONE] = 0
    return struct.pack(">QQ", prefixes.n, prefixes.whole()) + shown.tobytes()


def _likeness(a: bytes, b: bytes) -> float:
    if a == b:
        return 1.0
    x, y = np.frombuffer(a, np.uint8, SLOTS, 16), np.frombuffer(b, np.uint8, SLOTS, 16)
    filled = int(np.count_nonzero(x | y))
    share = np.count_nonzero((x == y) & (x > 0)) / max(1, filled)
    by_chance = 1 / int(_SLOT_VALUES)
    j = max(0.0, (share - by_chance) / (1 - by_chance))
    return 2 * j / (1 + j)


def likeness(a: str, b: str) -> float:
    """Likeness (0 to 1) of the texts of two fingerprints (hex); 1 for equal ones."""
    return _likeness(bytes.fromhex(a), bytes.fromhex(b))


class Document:
    """A text with its prefix arrays, the sketch of its first three quarters and
    its fingerprint.  Repeats of a span are numbered, so that each counts."""

    def __init__(self, doc_id, text: str | None):
        self.doc_id, self.text = doc_id, text or ""
        self.prefixes = Prefixes.of(self.text)
        n = self.prefixes.n
        self.head = n - n // 4
        self.hashes = span_hashes(self.prefixes, 1)
        x = _numbered_hashes(self.hashes)
        self.head_slots = sketch(x[:self.head])
        self.fingerprint = fingerprint(self.prefixes, np.minimum(self.head_slots, sketch(x[self.head:])))

    def against(self, after: "Document") -> tuple:
        """The result columns of this document followed by ``after``."""
        n, p, q = self.prefixes.n, self.prefixes, after.prefixes
        tail = min(n - self.head, q.n)
        edited = p.joined(self.head, q, tail)
        x = _numbered_hashes(np.concatenate([self.hashes[:self.head], span_hashes(edited, self.head + 1)]))
        slots = np.minimum(self.head_slots, sketch(x[self.head:]))
        text = self.text[:self.head] + after.text[:tail]
        mark = fingerprint(edited, slots)
        return (self.doc_id, n, hashlib.sha256(text.encode("utf-8")).digest(), self.fingerprint, mark,
                _likeness(self.fingerprint, mark), _likeness(self.fingerprint, after.fingerprint),
                p.extend_right(0, edited, 0), p.extend_left(n, edited, edited.n),
                p.extend_right(0, q, 0), p.extend_left(n, q, q.n))


_RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()),
    ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ("prefix_edited", pa.int64()), ("suffix_edited", pa.int64()), ("prefix_next", pa.int64()),
    ("suffix_next", pa.int64())])
_RESULT_SQL = ("doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, "
               "near_edited double, near_next double, prefix_edited long, suffix_edited long, prefix_next long, "
               "suffix_next long")
_ROWS_A_BATCH = 512


def _batches(rows, schema):
    """Record batches of bounded length from an iterator of tuples."""
    held: list = []

    def batch():
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    for r in rows:
        held.append(r)
        if len(held) >= _ROWS_A_BATCH:
            yield batch()
            held = []
    if held:
        yield batch()


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, fingerprint)`` of every row; a null text counts as empty."""
    schema = pa.schema([_RESULT.field(n) for n in ("doc_id", "n_chars", "fingerprint")])

    def run(batches):
        def rows():
            for b in batches:
                for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                    d = Document(i, t)
                    yield i, d.prefixes.n, d.fingerprint
        yield from _batches(rows(), schema)

    return _in_hex(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_chars long, fingerprint binary"))


def _in_hex(df: DataFrame) -> DataFrame:
    return df.select(*[F.lower(F.hex(c)).alias(c) if t == "binary" else F.col(c) for c, t in df.dtypes])


def edited_and_next(docs: DataFrame, part_text_bytes: int = PART_TEXT_BYTES) -> DataFrame:
    """Every document against its edited text and the next document.

    Documents follow each other in ascending ``doc_id`` (nulls first; rows of one
    id by text), after the last comes the first.  The edited text has the last
    quarter of the code points (rounded down) replaced by as many, or all, first
    ones of the next document.  A null text counts as empty; two empty texts are
    equal (likeness 1); a single document follows itself; an empty table gives no
    rows; other columns are not read.

    Rows are range-partitioned and sorted, so a task meets most neighbours in
    passing; only the first and last row of each partition are paired afterwards.
    Columns: ``_RESULT``; ``prefix_*`` and ``suffix_*`` are the longest common
    extensions from the texts' starts and ends.
    """
    spark, cuts = docs.sparkSession, Cuts(docs.sparkSession)
    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = frame.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    keys = ["doc_id", "__h"]
    placed = (frame.withColumn("__h", F.xxhash64("text"))
              .repartitionByRange(max(1, -(-size // part_text_bytes)), *keys)
              .sortWithinPartitions(*keys, "text").select(F.spark_partition_id().alias("part"), "doc_id", "text"))
    # kind r: a result; f and l: the first and the last row of a partition
    head = [pa.field("kind", pa.string()), pa.field("part", pa.int32()), pa.field("text", pa.string())]
    schema = pa.schema([*head, *_RESULT])
    blank = (None,) * (len(_RESULT) - 1)

    def neighbours(batches):
        def rows():
            before, part = None, None
            for b in batches:
                for part, i, t in zip(*(b.column(c).to_pylist() for c in ("part", "doc_id", "text"))):
                    now = Document(i, t)
                    if before is None:
                        yield "f", part, now.text, i, *blank
                    else:
                        yield "r", part, None, *before.against(now)
                    before = now
            if before is not None:
                yield "l", part, before.text, before.doc_id, *blank
        yield from _batches(rows(), schema)

    found = cuts.cut(placed.mapInArrow(neighbours, "kind string, part int, text string, " + _RESULT_SQL))
    # a row for each partition: the bound of this window and of its broadcast
    order = Window.orderBy("part")
    after = found.where("kind = 'f'").select("part", F.coalesce(
        F.lead("part").over(order), F.min("part").over(order)).alias("after"))
    firsts = found.where("kind = 'f'").select(F.col("part").alias("after"), F.col("doc_id").alias("next_id"),
                                              F.col("text").alias("next_text"))
    edges = (found.where("kind = 'l'").select("part", "doc_id", "text")
             .join(F.broadcast(after), "part").join(firsts, "after").drop("part", "after"))

    def pair(batches):
        def rows():
            for b in batches:
                for r in b.to_pylist():
                    yield Document(r["doc_id"], r["text"]).against(Document(r["next_id"], r["next_text"]))
        yield from _batches(rows(), _RESULT)

    return _in_hex(found.where("kind = 'r'").select(*_RESULT.names).unionByName(edges.mapInArrow(pair, _RESULT_SQL)))


def op11_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_and_next(table(spark, sf_dir, "documents"))
