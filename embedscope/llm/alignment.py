"""Cross-tokenizer alignment: which tokens of two vocabularies end together.

Every text is tokenised whole, by a byte-level file (A, of a space and the text)
and by a sentence-piece file (B, which adds that space).  The byte ranges of both
token sequences tile the same bytes, so a token of A and one of B may end
together; such ends cut both sequences into groups.

*Units*: both files split a text before the white space that follows a word, so no
token of either goes over that place and an end is shared there.  A text is its units
(mostly words), one after the other, and its groups are those of its units.  A unit is
encoded by both libraries, verified byte for byte and cut into groups once; its
numbers, links and groups are kept in a table of bounded size.  Documents look up
their units; what they return follows from the units by array steps.

How often a pair of ids is linked in the whole corpus is an aggregate over the
documents' distinct pairs; a join brings the counts back to the documents.
"""

from __future__ import annotations

import gc
import hashlib
import re
from array import array
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embedscope.llm.encode import _OTHER_SPACE, _SHOWN, distinct, encoder
from embedscope.llm.work import Cuts, table

MEMO_ENTRIES = 300_000  # units of each of two generations
PIECE_ENTRIES = 4_000_000  # tokens of these units
GROUP_CHARS = 1 << 20
MARK = "▁"
#: Pairs of ids that are broadcast (24 bytes each); beyond, the same join shuffles.
PAIR_BROADCAST_ROWS = 2_000_000

_BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")
#: Units of a text with tabs or carriage returns: B may go on over these, so only a
#: space or a line end after a word begins the next unit.
_GLUED = re.compile(rb"[ \t\n\r]*[^ \t\n\r]+(?:[\t\r][ \t\n\r]*[^ \t\n\r]+)*|[ \t\n\r]+")


class Pieces:
    """Ids of units by a sentence-piece file.

    ``parted``: no piece goes on after a space or over a line end (checked when the
    file is read), so the ids of a text are those of its units.  ``signs``: the ids of
    signs that no piece joins to a letter or digit before them.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(m[1], 16)]) if (m := _BYTE_PIECE.fullmatch(p)) and self.model.is_byte(i)
                      else p.replace(MARK, " ").encode("utf-8") for i, p in enumerate(names)]
        plain = [p for i, p in enumerate(names) if not self.model.is_control(i) and not self.model.is_unknown(i)]
        # a line end and what follows it are encoded after the added space
        lead = self.model.encode("\n")
        self.parted = (not any(MARK in p.lstrip(MARK) or "\n" in p for p in plain)
                       and len(lead) == 2 and self.bytes[lead[0]] == b" ")
        joined = {b for p in plain for a, b in zip(p, p[1:]) if a.isalnum()}
        self.signs = {c.encode(): i for c in ".," if c not in joined and (i := names.index(c) if c in names else None)}

    def units(self, keys: list) -> list[list[int]]:
        """The ids of each key's unit (see :meth:`Aligner._keys`)."""
        texts = [k[1] if type(k) is tuple else k for k in keys]
        # the space that the library adds is the unit's own, or no part of it
        done = self.model.encode([(t[1:] if t[:1] == b" " else t).decode("utf-8") for t in texts], num_threads=1)
        return [ids if t[:1] == b" " else [self.signs[t]] if t in self.signs else ids[1:]
                for t, ids in zip(texts, done)]


class Units:
    """Aligned units by key: numbers of tokens and links, links, groups as text (each
    after a semicolon).  A unit that a file does not give back has no link."""

    def __init__(self):
        self.index: dict = {}
        self.texts: list[str] = []
        self.n_a, self.n_b, self.n_links, self.start, self.links = (array("q") for _ in range(5))
        self.tokens = 0

    def add(self, keys, n_a, n_b, n_links, links, texts) -> None:
        self.index.update(zip(keys, range(len(self.texts), len(self.texts) + len(texts))))
        self.texts += texts
        self.tokens += int(n_a.sum() + n_b.sum())
        start = len(self.links) + np.cumsum(n_links) - n_links
        for held, new in zip((self.n_a, self.n_b, self.n_links, self.start, self.links),
                             (n_a, n_b, n_links, start, links)):
            held.frombytes(new.astype(np.int64).tobytes())

    def take(self, at: np.ndarray):
        """``(n_a, n_b, n_links)`` of some units, and their links one after the other."""
        n_a, n_b, n_links, start = (np.frombuffer(x, np.int64)[at]
                                    for x in (self.n_a, self.n_b, self.n_links, self.start))
        first = np.cumsum(n_links) - n_links
        links = np.frombuffer(self.links, np.int64) if self.links else np.empty(0, np.int64)
        return n_a, n_b, n_links, links[np.repeat(start - first, n_links) + np.arange(int(n_links.sum()))]


class Aligner:
    """Aligns texts; keeps the alignments of recent units."""

    def __init__(self, path_a: str, path_b: str):
        self.a = encoder(path_a, True, plain_specials=True, lead_space=True)
        self.b = Pieces(path_b)
        vocab = self.a.tokenizer.get_vocab(with_added_tokens=False)
        back = {chr(c): b for b, c in _SHOWN.items()} | {chr(b): b for b in range(256) if b not in _SHOWN}
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for name, i in vocab.items():
            self.a_bytes[i] = bytes(back[c] for c in name)
        self.length_a, self.length_b = (np.array([len(x) for x in s], np.int64) for s in (self.a_bytes, self.b.bytes))
        # ids as text after each separator
        self.shown_a = [np.array([c + str(i) for i in range(len(self.a_bytes))], object) for c in ",;"]
        self.shown_b = [np.array([c + str(i) for i in range(len(self.b.bytes))], object) for c in ",|"]
        self.signs = b"".join(c for c in self.a.signs if c in self.b.signs)
        self.units, self.older = Units(), Units()

    @property
    def memo(self) -> dict:
        return self.units.index

    def align(self, texts: list[str | None]) -> list[tuple]:
        """``(n_a, n_b, groups, pairs, counts)`` of each text: the groups as text,
        its distinct linked pairs and how often each is linked.  Texts without
        tokens have zeros and nothing."""
        # many lists and tuples without cycles: seek none until they are gone
        gc.disable()
        try:
            return self._align(texts)
        finally:
            gc.enable()

    # Keys are those of the encoder of A with a space before each text, and (2, a space
    # and the text) for a text that is a unit of its own.

    def _even(self, text: str) -> bytes | None:
        return self.a._even(text) if self.b.parted and MARK not in text else None

    def _keys(self, text: str) -> list:
        if not text:
            return []
        whole = [(2, b" " + text.encode("utf-8"))]
        if not self.b.parted or MARK in text or text[-1] in " \t\r":
            return whole
        if "\t" not in text and "\r" not in text:
            return self.a._keys(text) or whole
        if _OTHER_SPACE.search(text):
            return whole
        units = _GLUED.findall(whole[0][1])
        if units[-1][:1] in b"\t\r":
            return whole
        return [u if u[:1] in b" \n" and u.split() == [u[1:]] else (1, u) for u in units]

    def _align(self, texts: list[str | None]) -> list[tuple]:
        if len(self.units.texts) > MEMO_ENTRIES or self.units.tokens > PIECE_ENTRIES:
            self.units, self.older = Units(), self.units
        texts = [t or "" for t in texts]
        even = [self._even(t) for t in texts]
        # even texts first
        order = sorted(range(len(texts)), key=lambda i: even[i] is None)
        keys, which, sizes = distinct([even[i] for i in order if even[i] is not None], self.signs)
        odd = [self._keys(texts[i]) for i in order[len(sizes):]]
        which = np.concatenate([which, len(keys) + np.arange(sum(map(len, odd)))])
        sizes = np.concatenate([sizes, np.array([len(more) for more in odd], np.int64)])
        keys += chain.from_iterable(odd)
        units = self.units
        at = np.array(list(map(units.index.get, keys, repeat(-1))), np.int64)
        lost = np.flatnonzero(at < 0)
        if len(lost):
            names = [keys[i] for i in lost.tolist()]
            self._learn(list(dict.fromkeys(names)))
            at[lost] = [units.index[k] for k in names]
        at = at[which]
        doc = np.repeat(np.arange(len(texts)), sizes)
        broken = np.zeros(len(texts), bool)  # a file does not give these back
        broken[doc[np.frombuffer(units.n_links, np.int64)[at] == 0]] = True
        if broken.any():
            at, sizes = at[~broken[doc]], np.where(broken, 0, sizes)
        n_a, n_b, n_links, links = units.take(at)
        ends = np.cumsum(sizes)
        n_a, n_b, n_links = (np.diff(np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], ends])])
                             for n in (n_a, n_b, n_links))
        size_b, span = len(self.b.bytes), len(self.a_bytes) * len(self.b.bytes)
        found, counts = np.unique(np.repeat(np.arange(len(texts)) * span, n_links) + links, return_counts=True)
        per_doc = np.searchsorted(found, np.arange(len(texts) + 1) * span).tolist()
        code = found % span
        pairs = code // size_b << 32 | code % size_b
        shown = list(map(units.texts.__getitem__, at.tolist()))
        out: list = [None] * len(texts)
        for i, p, q, n, e, x, y in zip(order, n_a.tolist(), n_b.tolist(), sizes.tolist(), ends.tolist(),
                                       per_doc, per_doc[1:]):
            out[i] = (p, q, "".join(shown[e - n:e])[1:], pairs[x:y], counts[x:y])
        return out

    def _learn(self, keys: list) -> None:
        """Adds units that the table does not hold."""
        units, older = self.units, self.older
        known = np.array(list(map(older.index.get, keys, repeat(-1))), np.int64)
        kept = known[known >= 0]
        if len(kept):
            units.add([k for k, i in zip(keys, known.tolist()) if i >= 0], *older.take(kept),
                      [older.texts[i] for i in kept.tolist()])
            keys = [k for k, i in zip(keys, known.tolist()) if i < 0]
        if keys:
            units.add(keys, *self._fresh(keys))

    def _fresh(self, keys: list):
        """The columns of :meth:`Units.add` of some units, encoded and aligned."""
        ids = self.a._fresh(keys)
        parts_a, parts_b = [ids[k] for k in keys], self.b.units(keys)
        bytes_of = [k[1] if type(k) is tuple else k for k in keys]
        a = np.frombuffer(b"".join(parts_a), self.a.dtype).astype(np.int64)
        b = np.array(list(chain.from_iterable(parts_b)), np.int64)
        n_a = np.array([len(p) for p in parts_a], np.int64) // self.a.dtype.itemsize
        n_b = np.array([len(p) for p in parts_b], np.int64)
        good = (_give_back(a, n_a, self.a_bytes, self.length_a, bytes_of)
                & _give_back(b, n_b, self.b.bytes, self.length_b, bytes_of))
        if not good.all():
            a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
            n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
        # both sides tile the same bytes
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        ends = np.zeros((2, (int(end_a[-1]) if len(a) else 0) + 1), bool)
        ends[0, end_a], ends[1, end_b] = True, True
        last_a, last_b = ends[1, end_a], ends[0, end_b]
        at_a, at_b = np.flatnonzero(last_a), np.flatnonzero(last_b)
        stop_a, stop_b = np.cumsum(n_a), np.cumsum(n_b)
        n_links = np.diff(np.searchsorted(at_a, stop_a), prepend=0)
        # the text: tokens of A and B in turn, group by group
        first_a, first_b = (np.concatenate([[True], x])[:-1] for x in (last_a, last_b))
        group_a, group_b = np.cumsum(first_a) - 1, np.cumsum(first_b) - 1
        text = np.empty(len(a) + len(b), object)
        text[np.arange(len(a)) + np.concatenate([[0], at_b + 1])[group_a]] = np.where(
            first_a, self.shown_a[1][a], self.shown_a[0][a])
        text[np.arange(len(b)) + at_a[group_b] + 1] = np.where(first_b, self.shown_b[1][b], self.shown_b[0][b])
        text = text.tolist()
        stops = (stop_a + stop_b).tolist()
        shown = ["".join(text[i:j]) for i, j in zip([0, *stops], stops)]
        return n_a, n_b, n_links, a[at_a] * len(self.b.bytes) + b[at_b], shown


def _give_back(ids: np.ndarray, sizes: np.ndarray, names: list[bytes], lengths: np.ndarray,
               texts: list[bytes]) -> np.ndarray:
    """Which runs of ids (of ``sizes``) join to their texts."""
    stops = np.cumsum(sizes)
    joined = b"".join(map(names.__getitem__, ids.tolist()))
    at = np.concatenate([[0], np.cumsum(lengths[ids])])[stops]
    if joined == b"".join(texts) and (at == np.cumsum([len(t) for t in texts])).all():
        return np.ones(len(texts), bool)
    at = at.tolist()
    return np.array([joined[i:j] == t for i, j, t in zip([0, *at], at, texts)], bool)


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """This worker process's aligner for two vocabulary files."""
    key = (path_a, path_b)
    if key not in _aligners:
        _aligners[key] = Aligner(path_a, path_b)
    return _aligners[key]


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links)`` of every
    row; ``links`` holds the distinct linked pairs with their numbers in the text."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
        ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())),
        ("counts", pa.list_(pa.int32()))])

    def run(batches):
        both = aligner(path_a, path_b)
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and size < GROUP_CHARS:
                    size += len(texts[end] or "")
                    end += 1
                cols = [[] for _ in schema]
                for i, (n_a, n_b, groups, pairs, counts) in zip(ids[at:end], both.align(texts[at:end])):
                    links = int(np.sum(counts))
                    digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
                    for c, v in zip(cols, (i, n_a, n_b, links, links, digest, pairs, counts)):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
                at = end

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
             "pairs array<long>, counts array<int>")


def pair_counts(found: DataFrame) -> DataFrame:
    """``(pair, n, best)``: links of each pair of ids in the corpus, and whether no
    other pair with its B id has more."""
    exploded = found.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
    n = exploded.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("n"))
    # an id of B has at most as many partners as A has ids
    top = n.groupBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b")).agg(F.max("n").alias("top"))
    return n.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))).join(top, "b").select(
        "pair", "n", (F.col("n") == F.col("top")).alias("best"))


def alignment_summary(docs: DataFrame, path_a: str, path_b: str,
                      broadcast_rows: int = PAIR_BROADCAST_ROWS) -> DataFrame:
    """The counts of :func:`aligned` with ``n_best`` (links whose pair no other pair
    of its B id exceeds, ties included) and ``count_sum`` (corpus-wide counts of the
    pairs, summed over links).

    Null and empty texts, and texts that a vocabulary does not give back byte for
    byte, have no tokens: zeros and an empty ``groups_sha256``.  Repeated rows count
    as often as they occur; null ids stay null; an empty table gives no rows; other
    columns are not read.
    """
    cuts = Cuts(docs.sparkSession)
    found = cuts.cut(aligned(docs, path_a, path_b).withColumn("__row", F.monotonically_increasing_id()))
    counts = cuts.cut(pair_counts(found))
    links = found.select("__row", F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select(
        "__row", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("m"))
    few = counts.count() <= broadcast_rows
    per = (links.join(F.broadcast(counts) if few else counts, "pair").groupBy("__row").agg(
        F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).cast("long").alias("n_best"),
        F.sum(F.col("n") * F.col("m")).alias("count_sum")))
    zero = F.lit(0).cast("long")
    return found.drop("pairs", "counts").join(per, "__row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return alignment_summary(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                             public_tokenizers.path("piece_bpe_32k.model"))
