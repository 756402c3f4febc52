"""Embedding near-duplicates with randomised-rotation binary codes.

A unit vector o is rotated at random; its code is the sign of each rotated
coordinate, read as the unit vector c = sign / sqrt(d), and its stored correction
factor is f = <c, o>.  For another unit vector q (rotated as well) the quotient
<c, q> / f is an unbiased estimate of <o, q>, and its error stays within
``eps * sqrt((1 - f^2) / f^2 / (d - 1))`` with a probability that grows quickly
with ``eps``.  Independently of chance, <o, q> <= cos(arccos f - arccos <c, q>).
A pair whose upper bound, the smaller of the two, stays below the threshold from
either side is settled by the codes; all others are computed exactly, in double
precision, from the vectors as given.

Candidates come from the codes as well: bits of several rotations are cut into
``tables`` keys of ``bits`` bits, and vectors of one label that share a key join
the smallest vector under that key.  A pair at cosine 0.98 shares none of 64 keys
of 24 bits with probability 4e-7.  The connected groups of candidates are split
into blocks, and each pair of blocks of a group is one task, which returns link
counts and a spanning forest, never its pairs.  Equal vectors are one class from
the start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embedscope.llm.blocknames import dense_names
from embedscope.llm.components import components
from embedscope.llm.work import Cuts, table

THRESHOLD = 0.98
BITS = 24
TABLES = 64
BLOCK = 1024
EPS = 6.0
SEED = 4


def rotation(dim: int, number: int = 0, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix that only the arguments decide."""
    q, r = np.linalg.qr(np.random.default_rng((seed, dim, number)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def code_keys(units: np.ndarray, bits: int = BITS, tables: int = TABLES, seed: int = SEED) -> np.ndarray:
    """``(rows, tables)`` keys made of code bits of as many rotations as needed."""
    dim = units.shape[1]
    signs = []
    for number in range(1, 1 + -(-bits * tables // dim)):
        signs.append(units @ rotation(dim, number, seed) > 0)
    s = np.concatenate(signs, axis=1)[:, :bits * tables].reshape(len(units), tables, bits)
    return (s * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2) + (np.arange(tables, dtype=np.int64) << bits)


def usable(vectors: list) -> np.ndarray:
    """Which vectors are not null, hold only finite numbers and are not zero."""
    out = np.zeros(len(vectors), bool)
    for i, v in enumerate(vectors):
        if v is not None and len(v) and None not in v:
            a = np.asarray(v, np.float64)
            out[i] = bool(np.isfinite(a).all() and a.any())
    return out


def encoded(vectors: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated unit vectors, codes (as unit vectors) and correction factors."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    units = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
    turned = units @ rotation(units.shape[1], 0, seed)
    codes = np.where(turned > 0, 1.0, -1.0) / np.sqrt(units.shape[1])
    return turned, codes, (codes * turned).sum(axis=1)


def upper_bounds(f: np.ndarray, met: np.ndarray, dim: int, eps: float = EPS) -> np.ndarray:
    """Upper bounds of the inner products of coded vectors (factors ``f``, rows)
    with others, from ``met = <code, other>``: of the confidence interval around
    the estimate and of the spherical triangle inequality."""
    f = np.clip(f, 1e-12, 1.0)[:, None]
    met = np.clip(met, -1.0, 1.0)
    likely = met / f + eps * np.sqrt((1 - f * f) / (f * f) / max(1, dim - 1))
    certain = np.where(met >= f, 1.0, met * f + np.sqrt((1 - f * f) * (1 - met * met)))
    return np.minimum(likely, certain)


def block_links(vectors: np.ndarray, split: int | None, threshold: float) -> list[tuple[int, int]]:
    """Pairs (i < j; across ``split`` only, if given) with cosine >= threshold:
    bounds first, then the exact cosine of the pairs that are left."""
    turned, codes, f = encoded(vectors)
    met = codes @ turned.T
    slack = 1e-9  # of the float arithmetic of the bounds
    bound = upper_bounds(f, met, vectors.shape[1])
    maybe = np.triu((bound >= threshold - slack) & (bound.T >= threshold - slack), 1)
    if split is not None:
        maybe[:split, :split] = False
        maybe[split:, split:] = False
    i, j = np.nonzero(maybe)
    out = []
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    for s in range(0, len(i), 1 << 16):
        a, b = i[s:s + (1 << 16)], j[s:s + (1 << 16)]
        cos = (vectors[a] * vectors[b]).sum(axis=1) / (norms[a] * norms[b])
        ok = cos >= threshold
        out += list(zip(a[ok].tolist(), b[ok].tolist()))
    return out


def _forest(pairs: list[tuple[int, int]], m: int) -> list[tuple[int, int]]:
    parent = list(range(m))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in pairs:
        a, b = root(i), root(j)
        if a != b:
            parent[b] = a
            out.append((i, j))
    return out


def _matrix(column) -> np.ndarray:
    """Equally long lists as a double matrix."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(arr.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(arr), -1)


def near_vectors(vectors: DataFrame, cuts: Cuts, threshold: float = THRESHOLD, bits: int = BITS,
                 tables: int = TABLES, block: int = BLOCK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row of ``vectors``.

    Only vectors of one label (not null) and one dimension are compared.  Null,
    zero and not finite vectors, rows without a label and rows without an id are
    linked with nothing (the last have a null component and stay).  Repeated rows
    are copies of each other.  An empty table gives an empty result; other
    columns are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"),
                          F.col("embedding").cast("array<double>").alias("v"))
    big = F.lit(float("inf"))
    sound = (F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(
        (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))
        & F.exists("v", lambda x: x != 0), F.lit(False)))
    rows = cuts.cut(rows.withColumn("key", F.when(sound, F.sha2(F.concat_ws(
        ",", F.col("label").cast("string"), F.col("v").cast("string")), 256))))
    classes = cuts.cut(rows.where("key is not null").groupBy("key").agg(
        F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.any_value("label").alias("label"),
        F.any_value("v").alias("v")))
    # a class is a node, named by its smallest id; where an id has several vectors, by
    # numbers in the order of these ids
    shared = not classes.groupBy("first").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty()
    if shared:
        order = dense_names(classes.select("first", "key"), cuts).select("key", F.col("name").alias("node"))
        classes = cuts.cut(classes.join(order, "key"))
    else:
        classes = classes.withColumn("node", F.col("first"))
    names = classes.select("key", "node", "first", "copies")
    classes = classes.drop("key", "first")

    def keys(batches):
        for b in batches:
            dims = np.array([len(v) for v in b.column("v")], np.int64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = _matrix(b.column("v").take(pa.array(at)))
                x = x / np.abs(x).max(axis=1, keepdims=True)
                k = code_keys(x / np.linalg.norm(x, axis=1, keepdims=True), bits, tables)
                yield pa.RecordBatch.from_arrays(
                    [b.column("node").take(pa.array(at)), b.column("label").take(pa.array(at)),
                     pa.array(np.full(len(at), dim), pa.int64()), pa.array(list(k), pa.list_(pa.int64()))],
                    ["node", "label", "dim", "codes"])

    schema = classes.select("node", "label").schema.add("dim", "long").add("codes", T.ArrayType(T.LongType()))
    keyed = classes.select("node", "label", "v").mapInArrow(keys, schema).select(
        "node", "label", "dim", F.explode("codes").alias("code"))
    keyed = cuts.cut(keyed)
    hubs = keyed.groupBy("label", "dim", "code").agg(F.min("node").alias("hub"), F.max("node").alias("top")) \
        .where("hub <> top").drop("top")
    near = components(keyed.join(hubs, ["label", "dim", "code"]).where("node <> hub")
                      .select(F.col("node").alias("a"), F.col("hub").alias("b")), cuts)
    cuts.drop(keyed)
    members = classes.join(near, "node").withColumnRenamed("component", "grp")
    per = members.groupBy("grp", "label").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("blocks"))
    members = cuts.cut(members.join(per, ["grp", "label"]).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks"))))

    baskets = max(1, members.where("blocks = 1").count() // block)
    one = F.col("blocks") == 1
    minus = F.lit(-1).cast("long")
    tasks = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        F.when(one, F.pmod(F.xxhash64("grp"), F.lit(baskets))).otherwise(F.col("grp")).alias("k1"),
        F.when(one, minus).otherwise(F.least("block", "other")).alias("k2"),
        F.when(one, minus).otherwise(F.greatest("block", "other")).alias("k3"),
        F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"),
        F.xxhash64("grp", "label", F.size("v")).alias("part"), "node", "copies", "v")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("part", "ascending"), ("side", "ascending"), ("node", "ascending")])
        part, side = t["part"].to_numpy(), t["side"].to_numpy()
        node, copies = t["node"].to_numpy(), t["copies"].to_numpy()
        kind, a, b = [], [], []
        edges = np.flatnonzero(np.diff(part)) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(part)]):
            k2, k3 = t["k2"][lo].as_py(), t["k3"][lo].as_py()
            left = int((side[lo:hi] == 0).sum())
            if hi - lo < 2:
                continue
            pairs = block_links(_matrix(t["v"].slice(lo, hi - lo)), None if k2 == k3 else left, threshold)
            counts = np.zeros(hi - lo, np.int64)
            if pairs:
                i, j = np.array(pairs).T
                np.add.at(counts, i, copies[lo + j])
                np.add.at(counts, j, copies[lo + i])
            for x in np.flatnonzero(counts):
                kind.append(0)
                a.append(int(node[lo + x]))
                b.append(int(counts[x]))
            for i, j in _forest(pairs, hi - lo):
                kind.append(1)
                a.append(int(node[lo + i]))
                b.append(int(node[lo + j]))
        return pa.table({"kind": pa.array(kind, pa.int32()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    found = cuts.cut(tasks.groupBy("k1", "k2", "k3").applyInArrow(run, "kind int, a long, b long"))
    joined = components(found.where("kind = 1").select("a", "b"), cuts)
    links = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    named = (names.join(links, "node", "left").join(joined, "node", "left")
             .select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"),
                     F.coalesce("component", "node").alias("c")))
    if shared:  # a component's first node has its smallest id
        named = named.join(names.select(F.col("node").alias("c"), "first"), "c").select("key", "n", F.col("first").alias("c"))
    return rows.select("vec_id", "key").join(named, "key", "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("c", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("c", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), Cuts(spark))


OP4_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL),
n AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.norm > 0 AND b.norm > 0 AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= {THRESHOLD}),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings
  UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT r.vec_id, (SELECT count(*) FROM links l WHERE l.a = r.vec_id) AS n_links,
       min(r.other) AS component_id, r.vec_id = min(r.other) AS kept
FROM reach r GROUP BY r.vec_id
"""
