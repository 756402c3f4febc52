"""Near-duplicate detection with SuperMinHash signatures.

* Shingles: distinct runs of ``words`` words (a shorter text is one shingle).
* Signature: SuperMinHash.  Every element visits the slots in the order of its
  own random permutation; the value it offers at its j-th slot lies in [j, j+1),
  so the ranks within one element are correlated and the estimate varies less
  than with independent minima.  Elements advance together, one slot a step, and
  stop early as soon as each slot of their document holds a value below the step.
* Banding: ``bands`` bands of ``rows`` slots.  Documents with equal sets are one
  class from the start; classes that share a band are candidates, joined to the
  smallest class in that band (never as all pairs of the band).
* Verification: the candidates of one candidate component are compared exactly,
  on full sets, in blocks of bounded size; each task returns a spanning forest
  of the links that it finds.  In a component of several blocks, blocks come
  first, then the representatives of what they joined, and last all pairs of
  blocks that still hold different components: no link can be lost in between.
* Union-find grouping: connected components of the verified links.

A pair exactly at the threshold 0.8 shares none of 48 bands of 6 slots with
probability 5e-7; one at 0.85 shares none of 36 bands of 7 with probability 1e-6.  Set elements are 64-bit
hashes of the shingles.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from embedscope.llm.blocknames import dense_names
from embedscope.llm.components import components
from embedscope.llm.encode import forget
from embedscope.llm.work import Cuts, release_memory, row_keyed, slices, table

BANDS = 48
ROWS = 6
GROUP_ELEMENTS = 100_000
BLOCK_DOCS = 256
BLOCK_SHINGLES = 1_000_000

_G = np.uint64(0x9E3779B97F4A7C15)
_A = np.uint64(0xBF58476D1CE4E5B9)
_B = np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's shingles.

    Only A-Z are lower-cased; words are parted by space and U+0009 to U+000D.
    """
    parts = (text or "").encode("utf-8").lower().split()  # of bytes: ASCII rules
    n = len(parts)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, parts), np.uint64, n)
    k = min(n, words)
    s = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        s = _mixed(s * _G + h[i:n - k + 1 + i])
    return np.unique(s)


def signatures(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """SuperMinHash values, ``(len(sets), slots)``; rows of empty sets stay maximal."""
    docs = len(sets)
    e = np.concatenate(sets) if docs else np.empty(0, np.uint64)
    d = np.repeat(np.arange(docs), [len(s) for s in sets])
    flat = np.full(docs * slots, np.iinfo(np.uint64).max, np.uint64)
    table = flat.reshape(docs, slots)
    earlier: list[np.ndarray] = []
    perm = None
    for j in range(slots):
        if not len(e):
            break
        r = _mixed(e + np.uint64((2 * j + 1) * int(_G) & (1 << 64) - 1))
        k = (((_mixed(r ^ _B) >> np.uint64(32)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64) + j
        if perm is None:
            slot = k
            for t in range(j - 1, -1, -1):  # where the earlier swaps brought slot k from
                slot = np.where(slot == earlier[t], t, slot)
            earlier.append(k)
        else:
            at = np.arange(len(e))
            slot = perm[at, k]
            perm[at, k] = perm[:, j]
        np.minimum.at(flat, d * slots + slot, (np.uint64(j) << np.uint64(53)) | (r >> np.uint64(11)))
        open_docs = table.max(axis=1) >= (np.uint64(j + 1) << np.uint64(53))
        live = open_docs[d]
        if not live.all():
            e, d = e[live], d[live]
            earlier = [x[live] for x in earlier]
            perm = perm[live] if perm is not None else None
        if perm is None and j == 5:  # few elements are left: keep their permutations
            perm = np.tile(np.arange(slots, dtype=np.int64 if slots > 32767 else np.int16), (len(e), 1))
            at = np.arange(len(e))
            for t, x in enumerate(earlier):
                held = perm[at, x]
                perm[at, x] = perm[:, t]
                perm[:, t] = held
    return table


def band_hashes(table: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(table), bands), np.uint64)
    for b in range(bands):
        acc = np.full(len(table), b + 1, np.uint64)
        for r in range(rows):
            acc = _mixed(acc * _G + table[:, b * rows + r])
        out[:, b] = acc
    return out


def sign(docs: DataFrame, keys: list[str], words: int, bands: int, rows: int) -> DataFrame:
    """``(*keys, doc_id, n_shingles, set_key, bands)`` of every whole text."""
    frame = docs.select(*keys, "doc_id", "text")
    passed = [*keys, "doc_id"]
    schema = frame.drop("text").schema.add("n_shingles", "long").add("set_key", "binary") \
        .add("bands", T.ArrayType(T.LongType()))

    def run(batches):
        forget()
        b = sets = hashes = None
        for b in slices(batches, "text"):
            counts, names, hashes, sets, size = [], [], [], [], 0

            def flush():
                for row in band_hashes(signatures(sets, bands * rows), bands, rows):
                    hashes.append(row.view(np.int64))
                sets.clear()

            for t in b.column("text").to_pylist():
                s = shingle_set(t, words)
                counts.append(len(s))
                names.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sets.append(s)
                size += len(s)
                if size >= GROUP_ELEMENTS:
                    flush()
                    size = 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in passed] + [pa.array(counts, pa.int64()), pa.array(names, pa.binary()),
                                                 pa.array(hashes, pa.list_(pa.int64()))],
                [*passed, "n_shingles", "set_key", "bands"])
        b = sets = hashes = None
        release_memory()

    return frame.mapInArrow(run, schema)


def linked(sets: list[np.ndarray], split: int | None, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with ``100 * common >= percent * union``;
    with ``split``, of the pairs across that position only.

    Common elements are counted by matrix products over the elements that occur
    more than once, a bounded number of columns at a time.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(m), sizes)
    _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen[column] > 1
    owner, column = owner[shared], column[shared]
    ids, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((m, m))
    wide = max(1024, (4 << 20) // max(1, m))
    for c in range(0, len(ids), wide):
        lo, hi = np.searchsorted(column, (c, c + wide))
        x = np.zeros((m, min(wide, len(ids) - c)), np.float32)
        x[owner[lo:hi], column[lo:hi] - c] = 1.0
        common += x @ x.T
    union = sizes[:, None] + sizes[None, :] - common
    ok = np.triu(100 * common >= percent * union, 1) & (sizes > 0)[:, None]
    if split is not None:
        ok[:split, :split] = False
        ok[split:, split:] = False
    parent = list(range(m))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i, j in zip(*np.nonzero(ok)):
        a, b = root(int(i)), root(int(j))
        if a != b:
            parent[b] = a
            out.append((int(i), int(j)))
    return out


def _verify(tasks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)`` found in tasks ``(k1, k2, k3, grp, node)``: within each
    ``grp`` of a task, or, where ``side`` differs, across the sides."""

    def run(t: pa.Table) -> pa.Table:
        forget()
        t = t.sort_by([("grp", "ascending"), ("side", "ascending"), ("node", "ascending")])
        grp, side = t["grp"].to_numpy(), t["side"].to_numpy()
        node, data = t["node"].to_numpy(), t["elements"].to_pylist()
        a, b = [], []
        edges = np.flatnonzero(np.diff(grp)) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(grp)]):
            if hi - lo < 2:
                continue
            left = int((side[lo:hi] == 0).sum())
            pairs = linked([np.frombuffer(x, np.uint64) for x in data[lo:hi]],
                           left if left < hi - lo else None, percent)
            a += [int(node[lo + i]) for i, _ in pairs]
            b += [int(node[lo + j]) for _, j in pairs]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return tasks.join(sets.hint("merge"), "node").groupBy("k1", "k2", "k3").applyInArrow(run, "a long, b long")


def _blocked(nodes: DataFrame) -> DataFrame:
    """``nodes (node, grp, n)`` with ``blocks`` (of the group) and ``block``."""
    per = nodes.groupBy("grp").agg(F.sum("n").alias("s"), F.count(F.lit(1)).alias("c")).select(
        "grp", F.greatest(F.ceil(F.col("c") / BLOCK_DOCS), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("long")
        .alias("blocks"))
    return nodes.join(per, "grp").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))


def _within_blocks(nodes: DataFrame, sets: DataFrame, percent: int, baskets: int) -> DataFrame:
    """Links inside each block; groups of one block share tasks, by hash."""
    one = F.col("blocks") == 1
    return _verify(nodes.select(
        F.when(one, F.pmod(F.xxhash64("grp"), F.lit(baskets))).otherwise(F.col("grp")).alias("k1"),
        F.when(one, F.lit(-1).cast("long")).otherwise(F.col("block")).alias("k2"), F.lit(-1).cast("long").alias("k3"),
        "grp", F.lit(0).alias("side"), "node"), sets, percent)


def near_groups(docs: DataFrame, keys: list[str], cuts: Cuts, words: int = 5, percent: int = 80,
                bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(*keys, doc_id, n_shingles, component_id, kept)`` per row of ``docs``.

    Null, empty and blank texts have no shingles and are linked with nothing.
    Rows of equal texts are in one class, whatever their ids, and rows that repeat
    an id with other texts are documents of their own; a row without id is linked
    with nothing, has a null component and stays.  An empty table gives an empty result; other columns are not read.
    """
    signed = cuts.cut(sign(docs, keys, words, bands, rows))
    classes = cuts.cut(signed.where("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(
        F.min(F.col("doc_id").cast("long")).alias("first"), F.any_value("n_shingles").alias("n"),
        F.any_value("bands").alias("bands")))
    # a class is a node, named by its smallest id; where an id has several texts, by
    # numbers in the order of these ids
    shared = not classes.groupBy("first").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty()
    classes = classes.withColumn("node", F.col("first"))
    if shared:
        order = dense_names(classes.select("first", "set_key"), cuts).select("set_key", F.col("name").alias("node"))
        classes = cuts.cut(classes.drop("node").join(order, "set_key"))
    banded = classes.select("node", F.explode("bands").alias("h"))
    hubs = banded.groupBy("h").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub <> top")
    near = components(banded.join(hubs.select("h", "hub").hint("merge"), "h").where("node <> hub")
                      .select(F.col("node").alias("a"), F.col("hub").alias("b")), cuts)
    nodes = cuts.cut(_blocked(classes.join(near, "node").select(
        "node", F.col("component").alias("grp"), "n", "set_key", "first")))

    picked = nodes.select(F.col("node").alias("__node"), F.col("set_key").alias("__key"), F.col("first").alias("__first"))
    # merge joins at every size: no plan that only small inputs can have
    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), "text").join(
        picked.hint("merge"), F.col("__id") == F.col("__first")).select("__node", "__key", "text")

    def elements(batches):
        forget()
        b = made = right = None
        for b in slices(batches, "text"):
            made = [shingle_set(t, words).tobytes() for t in b.column("text").to_pylist()]
            right = [hashlib.blake2b(m, digest_size=16).digest() == k
                     for m, k in zip(made, b.column("__key").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("__node").filter(pa.array(right)),
                 pa.array([m for m, ok in zip(made, right) if ok], pa.binary())], ["node", "elements"])
        del b, made, right
        release_memory()

    sets = texts.mapInArrow(elements, "node long, elements binary")
    repeated = signed.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    if not repeated.isEmpty():  # rows that repeat an id and its text give the set twice
        sets = sets.groupBy("node").agg(F.any_value("elements").alias("elements"))
    sets = cuts.cut(sets)

    total = nodes.agg(F.sum("n")).first()[0] or 0
    baskets = max(1, -(-total // BLOCK_SHINGLES))
    links = cuts.cut(_within_blocks(nodes, sets, percent, baskets))
    joined = components(links, cuts)
    # groups of several blocks: representatives, as long as that joins anything
    wide = cuts.cut(nodes.where("blocks > 1").select("node", "grp", "n", "block"))
    held = not wide.isEmpty()
    while held:
        named = wide.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
        open_groups = cuts.cut(named.groupBy("grp").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
                               .where("lo <> hi").select("grp"))
        held = not open_groups.isEmpty()
        if not held:
            break
        heads = _blocked(named.where("component = node").join(open_groups, "grp").select("node", "grp", "n"))
        more = cuts.cut(_within_blocks(heads, sets, percent, baskets))
        if more.isEmpty():
            break
        # the components so far are stars: few rounds join them further
        joined = components(joined.toDF("a", "b").unionByName(more), cuts)
    if held:
        # what is still apart: all pairs of blocks that hold more than one component
        named = cuts.cut(named.select("node", "grp", "block", "component"))
        spans = named.groupBy("grp", "block").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        other = spans.select("grp", *[F.col(c).alias(f"{c}2") for c in ("block", "lo", "hi")])
        pairs = cuts.cut(spans.join(other, "grp").where("block < block2 and least(lo, lo2) <> greatest(hi, hi2)")
                         .select("grp", "block", "block2"))
        if not pairs.isEmpty():
            sides = [named.join(pairs.withColumnRenamed("block" if s else "block2", "__o").withColumnRenamed(
                "block2" if s else "block", "block"), ["grp", "block"]).select(
                    F.col("grp").alias("k1"), F.least("block", "__o").alias("k2"),
                    F.greatest("block", "__o").alias("k3"), "grp", F.lit(s).alias("side"), "node") for s in (0, 1)]
            more = _verify(sides[0].unionByName(sides[1]), sets, percent)
            joined = components(joined.toDF("a", "b").unionByName(more), cuts)

    final = classes.select("set_key", "node").join(joined, "node", "left").select(
        "set_key", F.coalesce("component", "node").alias("__c"))
    if shared:  # nodes are in the order of ids, so a component's first node has its smallest id
        final = final.join(classes.select(F.col("node").alias("__c"), "first"), "__c").select(
            "set_key", F.col("first").alias("__c"))
    own = F.col("doc_id").cast("long")
    return signed.select(*keys, "doc_id", "n_shingles", "set_key").join(final.hint("merge"), "set_key", "left").select(
        *keys, "doc_id", "n_shingles",
        F.when(own.isNotNull(), F.coalesce("__c", own)).alias("component_id"),
        (own.isNull() | (F.coalesce("__c", own) == own)).alias("kept"))


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near copies (the smallest id); columns unchanged."""
    cuts = Cuts(docs.sparkSession)
    keyed = row_keyed(docs, cuts)
    flat = keyed.select("__file", "__row", F.col("__doc.doc_id").alias("doc_id"), F.col("__doc.text").alias("text"))
    kept = near_groups(flat, ["__file", "__row"], cuts, words, percent).where("kept").select("__file", "__row")
    return (keyed.join(kept, ["__file", "__row"], "left_semi")
            .select(*[F.col("__doc")[n].alias(n) for n in docs.columns]))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), [], Cuts(spark), words=3, percent=85, bands=36, rows=7)


def near_sql(words: int, percent: int, docs: str = "documents") -> str:
    """The same result in DuckDB SQL, by comparing all pairs that share a shingle."""
    upper = "".join(map(chr, range(65, 91)))
    gram = " || ' ' || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(words))
    return f"""
WITH RECURSIVE parts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'),
                                    '[^\\x20\\x09-\\x0D]+') AS w FROM {docs}),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {words - 2}), lambda i: {gram})) END AS s FROM parts),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) + any_value(b.n) AS n, count(*) AS c
  FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common WHERE 100 * c >= {percent} * (n - c)
  UNION ALL SELECT b, a FROM common WHERE 100 * c >= {percent} * (n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM sets
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT doc_id, any_value(len(s)) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM reach JOIN sets USING (doc_id) GROUP BY doc_id
"""


OP2_SQL = near_sql(3, 85)
