"""Spelling variants: words one code point apart, by a bit-sliced position index.

An index over a block of words holds, for each place and letter, a bitset of the
words with that letter there.  A query word runs through it letter by letter, and a
recurrence of ANDs and ORs, 64 words at a time, tracks side by side the words that
agree so far (zero errors), and those with one error so far: a replaced letter (same
place), a letter that the query lacks (index one place ahead) or that it has in excess
(one place behind).

Only words that may be one apart share a block.  Of two words that differ by one code
point, the shorter of length ``s``, the first or the last ``s // 2`` code points agree
(the edit lies in one half only).  So each word joins four *groups*: for ``s`` its
length and one less, its first and its last ``s // 2`` code points.  A group of more
than ``GROUP_WORDS`` words is divided by the same argument: also the first or the last
half of the rest agrees.  What is still larger is compared in tiles of query blocks
and index blocks.  Small groups share a block; a query starts from the members of its
own group.  Each pair counts in one group alone: where the first part agrees, the
group of the last part leaves it out, which the zero-error set of that place tells.

Nothing of a pair leaves a task but its share in the word's neighbour count and best
neighbour.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embedscope.llm.work import Cuts, table

LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
DELETED_ONE_IN = 199
BLOCK_WORDS = 1024
GROUP_WORDS = 8192
QUERY_WORDS = 256  # that run through an index together
_COUNTER_WORDS = 400_000
_COUNTER_ROWS = 20_000

_RUN = re.compile("[a-zA-ZÀ-ÿ]+")
#: How a group was keyed, and which pairs it leaves to another group.
FIRST, LAST, FIRST_FIRST, FIRST_LAST, LAST_FIRST, LAST_LAST = range(6)


def runs(doc_id, text: str) -> Counter:
    """Words of one text with their numbers, some with a code point deleted."""
    # lower case of bytes is that of A-Z alone
    seen = Counter(_RUN.findall(text.encode("utf-8").lower().decode("utf-8")))
    out: Counter = Counter()
    prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for w, n in seen.items():
        h = zlib.crc32(w.encode("utf-8"), prefix)
        if h % DELETED_ONE_IN == 0:
            at = h % len(w)
            w = w[:at] + w[at + 1:]
        out[w] += n
    return out


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``(word, n)`` of the words that are long and frequent enough.  Null texts have
    no words; a null id counts as an empty one."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batches):
        held: Counter = Counter()

        def flush():
            rows = list(held.items())
            for at in range(0, len(rows), _COUNTER_ROWS):
                words, ns = zip(*rows[at:at + _COUNTER_ROWS])
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(ns, pa.int64())], schema=schema)
            held.clear()

        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                if not t:
                    continue
                for w, n in runs(i, t).items():
                    if len(w) >= least_length:
                        held[w] += n
                if len(held) > _COUNTER_WORDS:
                    yield from flush()
        yield from flush()

    return (docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count))


class PositionIndex:
    """Bitsets per (place, letter) over some words; rows of 64-bit pieces."""

    def __init__(self, words: list[str]):
        self.pieces = -(-len(words) // 64)
        self.lengths = np.array([len(w) for w in words])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        word = np.repeat(np.arange(len(words)), self.lengths)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.keys, row = np.unique(place << 21 | codes, return_inverse=True)
        # the last row is empty: no word has that letter there
        bits = np.zeros((len(self.keys) + 1, self.pieces * 64), np.uint8)
        bits[row, word] = 1
        self.rows = _packed(bits)

    def at(self, place: int, codes: np.ndarray) -> np.ndarray:
        """For each code, the words that have it at ``place``."""
        key = place << 21 | codes
        at = np.searchsorted(self.keys, key)
        hit = (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == key)
        return self.rows[np.where(hit, at, len(self.keys))]

    def of_length(self, n: int) -> np.ndarray:
        bits = np.zeros(self.pieces * 64, np.uint8)
        bits[:len(self.lengths)] = self.lengths == n
        return _packed(bits)


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=-1, bitorder="little").view("<u8")


def one_error(index: PositionIndex, queries: np.ndarray, members: np.ndarray, shorter: int,
              kind: np.ndarray) -> np.ndarray:
    """Bitsets of the words of ``index`` one code point from each query.

    ``queries``: codes of words of one length, a row each; ``members``: the bitsets
    that each starts from.  All words have ``shorter`` code points or one more; two of
    the larger length are left to the group of that length.  ``kind`` (a number a
    query) tells which pairs belong to another group.
    """
    count, n = queries.shape
    short, long = index.of_length(shorter), index.of_length(shorter + 1)
    half = shorter // 2
    quarter = (shorter - half) // 2
    zero = members
    longer = n == shorter  # the index words that may be longer: the query lacks a letter
    replaced = np.zeros_like(members)
    lacking = np.zeros_like(members)
    excess = np.zeros_like(members)
    skip = np.zeros_like(members)
    places = {LAST: half, LAST_FIRST: half, FIRST_LAST: half + quarter, LAST_LAST: quarter}
    for i in range(n + 1):
        for k, at in places.items():
            if at == i:
                skip = np.where((kind == k)[:, None], zero, skip)
        if i == n:
            break
        here = index.at(i, queries[:, i])
        if longer:
            replaced = (replaced & here) | (zero & ~here)
            lacking = (lacking | zero) & index.at(i + 1, queries[:, i])
        else:
            excess = (excess & index.at(i - 1, queries[:, i]) if i else excess) | zero
        zero = zero & here
    if longer:
        return ((replaced & short) | ((lacking | zero) & long)) & ~skip
    return excess & short & ~skip


def _neighbours(t: pd.DataFrame) -> pd.DataFrame:
    """``(word, n_near, form, form_n)`` of the query words of one block."""
    shorter = int(t["s"].iloc[0])
    t = t.sort_values(["word", "grp", "is_query"], kind="stable")
    of_index, of_query = t[t["is_index"]], t[t["is_query"]]
    out = []
    if len(of_index) and len(of_query):
        index = PositionIndex(of_index["word"].tolist())
        names, group = np.unique(np.concatenate([of_index["grp"], of_query["grp"]]), return_inverse=True)
        mine, group = group[:len(of_index)], group[len(of_index):]
        bits = np.zeros((len(names), index.pieces * 64), np.uint8)
        bits[mine, np.arange(len(of_index))] = 1
        members = _packed(bits)
        n = of_index["n"].to_numpy()
        words = of_index["word"].to_numpy()
        kinds = of_query["kind"].to_numpy()
        lengths = of_query["word"].str.len().to_numpy()
        for length in (shorter, shorter + 1):
            at = np.flatnonzero(lengths == length)
            for lo in range(0, len(at), QUERY_WORDS):
                some = at[lo:lo + QUERY_WORDS]
                asked = of_query["word"].iloc[some].tolist()
                codes = np.frombuffer("".join(asked).encode("utf-32-le"), "<u4").astype(np.int64).reshape(len(some), -1)
                near = one_error(index, codes, members[group[some]], shorter, kinds[some])
                q, piece = np.nonzero(near)
                if not len(q):
                    continue
                one = np.unpackbits(near[q, piece].astype("<u8")[:, None].view(np.uint8), axis=1, bitorder="little")
                k, bit = np.nonzero(one)
                q, w = q[k], piece[k] * 64 + bit
                # best first: most frequent, then smallest word (index words are sorted)
                order = np.lexsort((w, -n[w], q))
                q, w = q[order], w[order]
                first = np.flatnonzero(np.diff(q, prepend=-1))
                out.append(pd.DataFrame({
                    "word": [asked[i] for i in q[first]], "n_near": np.diff(np.append(first, len(q))),
                    "form": words[w[first]], "form_n": n[w[first]]}))
    if not out:
        return pd.DataFrame({"word": pd.Series([], dtype=str), "n_near": pd.Series([], dtype="int64"),
                             "form": pd.Series([], dtype=str), "form_n": pd.Series([], dtype="int64")})
    return pd.concat(out, ignore_index=True)


def _grouped(words: DataFrame, group_words: int, cuts: Cuts) -> DataFrame:
    """``(word, n, s, kind, grp)``: a row for each group of each word."""
    length = F.length("word")
    by_s = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("s")).where("s >= 1").withColumn(
        "half", F.floor(F.col("s") / 2).cast("int"))

    def key(kind, *parts):
        return F.struct(F.lit(kind).alias("kind"), F.concat_ws(":", F.lit(kind).cast("string"), F.col("s"), *parts).alias("grp"))

    first, last = F.expr("left(word, half)"), F.expr("if(half = 0, '', right(word, half))")
    rows = by_s.select("*", F.explode(F.array(key(FIRST, first), key(LAST, last))).alias("k")).select(
        "word", "n", "s", "half", "k.kind", "k.grp")
    sizes = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    # groups over the size hold that many of 4 rows a word: at most 4 * words / group_words rows
    large = cuts.cut(sizes.where(F.col("size") > group_words).select("grp", F.lit(True).alias("large")))
    if large.isEmpty():
        return rows.drop("half")
    few = large.count() <= 100_000
    rows = rows.join(F.broadcast(large) if few else large, "grp", "left").withColumn(
        "quarter", F.floor((F.col("s") - F.col("half")) / 2).cast("int"))
    fits = rows.where("large is null").select("word", "n", "s", "kind", "grp")
    wide = F.expr("left(word, half + quarter)")
    middle_last = F.expr("if(quarter = 0, '', right(word, quarter))")
    start = F.expr("left(word, quarter)")
    wide_last = F.expr("if(half + quarter = 0, '', right(word, half + quarter))")
    split = rows.where("large").select("word", "n", "s", F.explode(
        F.when(F.col("kind") == FIRST, F.array(key(FIRST_FIRST, wide), key(FIRST_LAST, first, middle_last)))
        .otherwise(F.array(key(LAST_FIRST, start, last), key(LAST_LAST, wide_last)))).alias("k"))
    return fits.unionByName(split.select("word", "n", "s", "k.kind", "k.grp"))


def near_words(words: DataFrame, cuts: Cuts, block_words: int = BLOCK_WORDS,
               group_words: int = GROUP_WORDS) -> DataFrame:
    """``(word, n_near, form, form_n)`` for every word of ``words (word, n)``, distinct
    words, that has a word one code point away: their number, the most frequent one
    (ties: the smallest) and its number.  Blocks bound a task; the result does not
    depend on them."""
    rows = cuts.cut(_grouped(words, group_words, cuts))
    sizes = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    # groups over a block: at most 8 * words / block_words rows
    big = cuts.cut(sizes.where(F.col("size") > block_words).select(
        "grp", F.ceil(F.col("size") / group_words).cast("int").alias("tiles")))
    few = big.count() <= 100_000
    total = {r.s: r.n for r in rows.groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a word length
    packs = F.create_map(*[F.lit(v) for s, n in total.items() for v in (s, max(1, -(-n // block_words)))]) \
        if total else F.create_map(F.lit(0), F.lit(1))
    rows = rows.join(F.broadcast(big) if few else big, "grp", "left").withColumns({
        "pack": F.when(F.col("tiles").isNull(), F.pmod(F.xxhash64("grp"), F.element_at(packs, F.col("s")))),
        "tiles": F.coalesce("tiles", F.lit(1))})
    own = F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int")
    # a row as query against each index block, and as index word for each query block
    roles = F.when(F.col("tiles") == 1, F.array(F.struct(
        F.lit(0).alias("qb"), F.lit(0).alias("ib"), F.lit(True).alias("is_query"), F.lit(True).alias("is_index")))
    ).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: F.when(
        j == own, F.array(F.struct(own.alias("qb"), j.alias("ib"), F.lit(True).alias("is_query"), F.lit(True).alias("is_index")))
    ).otherwise(F.array(
        F.struct(own.alias("qb"), j.alias("ib"), F.lit(True).alias("is_query"), F.lit(False).alias("is_index")),
        F.struct(j.alias("qb"), own.alias("ib"), F.lit(False).alias("is_query"), F.lit(True).alias("is_index")))))))
    rows = rows.select("word", "n", "s", "kind", "grp", "pack", F.explode(roles).alias("r")).select(
        "word", "n", "s", "kind", "grp", F.coalesce(F.concat(F.lit("p"), "pack"), F.concat(F.lit("g"), "grp")).alias("pack"),
        "r.*")
    found = rows.groupBy("s", "pack", "qb", "ib").applyInPandas(
        _neighbours, "word string, n_near long, form string, form_n long")
    return found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"),
        F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form"))).alias("b")).select(
        "word", "n_near", F.col("b.form").alias("form"), (-F.col("b.less")).alias("form_n"))


def _roots(formed: DataFrame, cuts: Cuts) -> DataFrame:
    """``(word, root)`` of the words with a form.  A form is more frequent than its
    word by a factor, so chains end; pointers double every round."""
    cur = cuts.cut(formed.select("word", F.col("form").alias("root")))
    while True:
        on = cur.select(F.col("word").alias("__w"), F.col("root").alias("__r"))
        new = cuts.cut(cur.join(on, F.col("root") == F.col("__w"), "left").select(
            "word", F.coalesce("__r", "root").alias("root"), F.col("__r").isNotNull().alias("moved")))
        cuts.drop(cur)
        cur = new
        if cur.where("moved").isEmpty():
            return cur.select("word", "root")


def spelling_variants(words: DataFrame, ratio: int = RATIO, block_words: int = BLOCK_WORDS,
                      group_words: int = GROUP_WORDS) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every row of ``words (word, n)``.

    ``form``: the most frequent word one code point away (ties: the smallest), if it
    is at least ``ratio`` times as frequent, else null; ``root`` follows forms to
    their end.  Words must be distinct; an empty table gives no rows.
    """
    cuts = Cuts(words.sparkSession)
    words = cuts.cut(words.select("word", "n"))
    near = cuts.cut(near_words(words, cuts, block_words, group_words))
    good = F.col("form_n") >= ratio * F.col("n")
    out = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n"))
    out = cuts.cut(out)
    roots = _roots(out.where("form is not null"), cuts)
    return out.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(vocabulary(table(spark, sf_dir, "documents")))
