"""Pivot index: exact neighbour search between balls of points that can meet.

The index divides the points into *balls*: each point belongs to its nearest pivot
and keeps its distance to it; a ball's radius is the largest of these.  Two balls
whose centres are farther apart than their radii and the search distance together
hold no neighbours, by the triangle inequality, so their tile is never built; in a
tile that is built, a row takes part only if its own distance to its pivot lets it
reach the other ball, and if its place on the line between the middles of the two does
(points are at least as far apart as their places on any line).  A pair of balls is one
tile for both directions.

Cosine distances are searched as Euclidean ones of the unit vectors (a zero vector
is at distance 1 from everything, so its ball has no bound).  The tile itself always
computes the metric asked for, from the given vectors.

Balls hold at most about ``block_rows`` points: larger ones are divided by pivots of
their own, and copies of one point, which no pivot can tell apart, by a hash.  Balls
of few points give theirs to the next pivot.  Up to ``block_rows`` points are one ball
without pivots.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embedscope.functions.kernels import components, pairwise, stack
from embedscope.functions.vectors import normalize
from embedscope.operators.pairs import (BLOCK_BYTES, DEFAULT_BLOCK_ROWS, LID, OWN_PARTITIONS, RID, Reducer, even_keys,
                                        pair_reduce)
from embedscope.session import cut_lineage, default_parallelism

#: Bounds of the pivots that every task of the first division gets.
MAX_PIVOTS = 1024
MAX_PIVOT_BYTES = 8 << 20
LEVELS = 3
LEAST_BALL = 32
CHUNK_ROWS = 8192
#: Tiles (some numbers each) up to this many are broadcast to the points.
TILE_BROADCAST_ROWS = 100_000
#: Pairs of units (both orders) for a task slot.
UNIT_PAIRS = 16
#: Rows of tiles that a task gathers before it makes fewer of them.
COMBINE_ROWS = 200_000

_BASE = {"euclidean": "euclidean", "sqeuclidean": "euclidean", "faiss_l2": "euclidean", "manhattan": "manhattan",
         "cosine": "euclidean", "faiss_cosine": "euclidean"}


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.where(n == 0, 1.0, n)[:, None]


def _prepared(metric: str, x: np.ndarray) -> np.ndarray:
    return _unit(x) if metric in ("cosine", "faiss_cosine") else x


def search_limit(metric: str, eps):
    """The distance in the index's space (number or column) that ``eps`` of the
    metric corresponds to, with room for rounding."""
    column = not isinstance(eps, (int, float))
    root = F.sqrt if column else math.sqrt
    e = eps if column else float(eps)
    if not column and not math.isfinite(e):
        return e
    if metric in ("cosine", "faiss_cosine"):
        e = root(2 * (F.greatest(e, F.lit(0.0)) if column else max(e, 0.0)))
    elif metric in ("sqeuclidean", "faiss_l2"):
        e = root(F.greatest(e, F.lit(0.0)) if column else max(e, 0.0))
    return e * (1 + 1e-6) + 1e-6


def _vectors(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = len(col)
    return np.asarray(col.flatten(), np.float64).reshape(n, -1) if n else np.zeros((0, 0))


@dataclass
class BallIndex:
    """``points (id, embedding, *attrs, ball, dc)`` and ``balls (ball, centre, radius,
    n)``, both written; ``single``: one ball without a bound."""

    points: DataFrame
    balls: DataFrame
    metric: str
    single: bool
    block_rows: int

    def with_points(self, points: DataFrame) -> "BallIndex":
        """The index over the same points with other columns."""
        return BallIndex(points, self.balls, self.metric, self.single, self.block_rows)

    def tiles(self, limits: DataFrame | float, only: DataFrame | None = None, diagonal: bool = True) -> DataFrame:
        """``(i, j, cc, ri, rj, li, lj)`` with ``i <= j``: the pairs of balls with
        points that may be within the larger of their limits (in the index's space:
        a number, or ``(ball, limit)``).  ``only (ball, only)``: pairs with the same
        value there (from 0) are left out."""
        b = self.balls.select("ball", "centre", "radius")
        b = b.join(limits, "ball") if isinstance(limits, DataFrame) else b.withColumn("limit", F.lit(float(limits)))
        b = b.join(only, "ball") if only is not None else b.withColumn("only", F.lit(-1).cast("long"))
        if self.single:
            own = b.where("only < 0") if diagonal else b.where("false")
            return own.select(F.col("ball").alias("i"), F.col("ball").alias("j"), F.lit(0.0).alias("cc"),
                              F.col("radius").alias("ri"), F.col("radius").alias("rj"),
                              F.col("limit").alias("li"), F.col("limit").alias("lj"))
        b = cut_lineage(b)
        met = pair_reduce(b, b, _Meeting(diagonal), metric=_BASE[self.metric], id_col="ball", vec_col="centre",
                          lattrs=("radius", "limit", "only"), rattrs=("radius", "limit", "only"), same_ids=True,
                          block_rows=self.block_rows)
        return cut_lineage(met.select(F.col(LID).alias("i"), F.col(RID).alias("j"), "cc", "ri", "rj", "li", "lj"))

    def tile_counts(self, eps: float) -> tuple[int, int]:
        """Tiles built and left out in a search within ``eps`` of the metric."""
        n = self.balls.count()
        kept = self.tiles(search_limit(self.metric, eps)).count()
        return kept, n * (n + 1) // 2 - kept

    def _units(self) -> int:
        """Units that the balls are dealt to: enough pairs of them for every task slot,
        whatever the number of balls, and more where one would hold too many bytes."""
        n, dim = self.balls.agg(F.sum("n"), F.max(F.size("centre"))).first()
        slots = default_parallelism(self.balls.sparkSession)
        return max(math.ceil(math.sqrt(UNIT_PAIRS * slots)), -(-8 * (n or 0) * max(1, dim or 1) // BLOCK_BYTES))

    def reduce(self, tiles: DataFrame, tile, schema: str, attrs=(), own_limit: str | None = None,
               combine=None, alone: bool = False) -> DataFrame:
        """``tile(d, left, right, diagonal)`` over the tiles: ``d`` is the distance block
        of the rows (id, attrs; in id order) of two balls (of one with itself: ``right is
        left``); gives a frame of ``schema``.  ``own_limit``: an attribute that bounds what
        a point searches, in the index's space.  ``combine``: makes fewer rows of those
        that a task has so far.  ``alone``: the tiles are of balls with themselves.

        The balls are dealt to units, and a task gets two units with all the tiles
        between them: a point is sent once for each unit that it may meet, not for each
        ball."""
        cols = ["id", "embedding", "dc", *attrs]
        spread = ["cc", "ri", "rj", "li", "lj"]
        alone = alone or self.single
        n_units = 1 if alone else self._units()

        def unit(c: str):
            return F.col(c) if alone else F.pmod(F.xxhash64(c), F.lit(n_units))

        # the ball of the smaller unit first
        turned = F.col("u") > F.col("v")

        def either(a: str, b: str):
            return F.when(turned, F.col(b)).otherwise(F.col(a)).alias(a)

        pairs = tiles.withColumns({"u": unit("i"), "v": unit("j")}).select(
            F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), either("i", "j"), either("j", "i"), "cc",
            either("ri", "rj"), either("rj", "ri"), either("li", "lj"), either("lj", "li"))
        few = self.single or tiles.count() <= TILE_BROADCAST_ROWS

        def wanted(own: str, other: str, where) -> DataFrame:
            """Balls with the pairs of units that take them, and how far from its pivot a
            point must be for the nearest of the tiles there."""
            gap = F.col("cc") - F.col("r" + other)
            return pairs.where(where).select(
                "u", "v", F.col(own).alias("ball"), F.when(F.col("i") == F.col("j"), F.lit(float("-inf"))).otherwise(gap).alias("gap"),
                F.greatest(F.col("l" + own), F.col("l" + other)).alias("both"), F.col("l" + other).alias("far"))

        def sent(need: DataFrame) -> DataFrame:
            reach = F.col("far") if own_limit else F.col("both")
            need = need.groupBy("u", "v", "ball").agg(F.min("gap").alias("gap"), F.min(F.col("gap") - reach).alias("least"))
            joined = self.points.join(F.broadcast(need) if few else need, "ball")
            # with room for rounding: the task looks at each tile again
            room = F.lit(1e-9) * (1 + F.col("dc"))
            near = ~(F.col("least") - room > F.col("dc"))
            if own_limit:
                near = near | ~(F.col("gap") - room > F.col("dc") + F.col(own_limit))
            return joined.where(near | (F.col("gap") == F.lit(float("-inf")))).select("u", "v", F.col("ball").alias("i"), *cols)

        inside = F.col("u") == F.col("v")
        left = sent(wanted("i", "j", F.lit(True)).unionByName(wanted("j", "i", inside)))
        left = left.unionByName(pairs.select("u", "v", "i", "j", *spread), allowMissingColumns=True)
        right = sent(wanted("j", "i", ~inside))
        right = right.select(*[F.col(c).alias(f"__{c}") for c in right.columns])
        metric = self.metric
        fields = T.StructType.fromDDL(schema).fields
        arrow = pa.schema([pa.field(f.name, {"long": pa.int64(), "integer": pa.int32(), "double": pa.float64(),
                                             "boolean": pa.bool_()}[f.dataType.typeName()]) for f in fields])

        def balls_of(table: pa.Table) -> dict:
            """The points of each ball in id order: vectors and other columns."""
            frame = table.drop_columns(["embedding"]).to_pandas()
            order = np.lexsort((frame["id"].to_numpy(), frame["i"].to_numpy()))
            frame, x = frame.iloc[order], _vectors(table.column("embedding"))[order]
            names, first = np.unique(frame["i"].to_numpy(), return_index=True)
            ends = [*first[1:], len(frame)]
            return {b: (x[s:e], frame.iloc[s:e]) for b, s, e in zip(names.tolist(), first.tolist(), ends)}

        def reaching(side, cc, other, own, far):
            x, rows = side
            reach = np.maximum(rows[own_limit].to_numpy() if own_limit else own, far)
            keep = ~(cc - rows["dc"].to_numpy() - other > reach)
            return side if keep.all() else (x[keep], rows[keep])

        def parted(a, b, la, lb):
            """The rows of both sides whose places on the line between their middles let
            them reach the other side."""
            (xa, rows_a), (xb, rows_b) = a, b
            pa_, pb = _prepared(metric, xa), _prepared(metric, xb)
            if metric in ("cosine", "faiss_cosine") and not (pa_.any(axis=1).all() and pb.any(axis=1).all()):
                return a, b  # a zero vector has no place
            line = pb.mean(axis=0) - pa_.mean(axis=0)
            length = math.sqrt(line @ line)
            if not 0 < length < math.inf:
                return a, b
            at, bt = pa_ @ (line / length), pb @ (line / length)
            room = 1e-12 * (np.abs(at).max() + np.abs(bt).max())
            keep = ~(bt.min() - at - room > np.maximum(rows_a[own_limit].to_numpy() if own_limit else la, lb))
            if not keep.any():
                return (xa[:0], rows_a[:0]), b
            if not keep.all():
                a, at = (xa[keep], rows_a[keep]), at[keep]
            keep = ~(bt - at.max() - room > np.maximum(rows_b[own_limit].to_numpy() if own_limit else lb, la))
            return a, b if keep.all() else (xb[keep], rows_b[keep])

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            is_tile = left.column("j").is_valid()
            todo = left.filter(is_tile).select(["i", "j", *spread]).to_pylist()
            own = balls_of(left.filter(pc.invert(is_tile)).select(["i", *cols]))
            other = own
            if right.num_rows:
                other = balls_of(right.rename_columns([c[2:] for c in right.column_names]).select(["i", *cols]))
            found, rows = [], 0
            for t in todo:
                diagonal = t["i"] == t["j"]
                if t["i"] not in own or t["j"] not in other:
                    continue
                a = b = own[t["i"]]
                if not diagonal:
                    with np.errstate(invalid="ignore"):
                        a = reaching(a, t["cc"], t["rj"], t["li"], t["lj"])
                        b = reaching(other[t["j"]], t["cc"], t["ri"], t["lj"], t["li"])
                        if len(a[1]) and len(b[1]):
                            a, b = parted(a, b, t["li"], t["lj"])
                    if not len(a[1]) or not len(b[1]):
                        continue
                d = pairwise(metric, a[0], b[0])
                p, q = a[1]["id"].to_numpy(), b[1]["id"].to_numpy()
                if diagonal or np.isin(p, q).any():
                    d[p[:, None] == q[None, :]] = 0.0
                found.append(tile(d, a[1], a[1] if diagonal else b[1], diagonal))
                rows += len(found[-1])
                if combine and rows > COMBINE_ROWS and len(found) > 1:
                    found = [combine(pd.concat(found, ignore_index=True))]
                    # next time when as many rows again have come
                    rows = 0
            some = [f for f in found if len(f)]
            if not some:
                return arrow.empty_table()
            out = pd.concat(some, ignore_index=True)
            out = combine(out) if combine and len(some) > 1 else out
            return pa.Table.from_pandas(out[arrow.names], arrow, preserve_index=False)

        count = n_units * (n_units + 1) // 2
        if alone or count > OWN_PARTITIONS:
            return left.groupBy("u", "v").cogroup(right.groupBy("__u", "__v")).applyInArrow(run, schema)
        # two units are a task of their own
        keys = F.array(*[F.lit(k).cast("long") for k in even_keys(self.points.sparkSession, count)])

        def dealt(side: DataFrame, p: str):
            u, v = F.col(f"{p}u"), F.col(f"{p}v")
            number = u * n_units - F.floor(u * (u - 1) / 2) + v - u
            return side.withColumn(f"{p}key", keys[number.cast("int")]).drop(f"{p}u", f"{p}v").repartition(count, f"{p}key").groupBy(f"{p}key")

        return dealt(left, "").cogroup(dealt(right, "__")).applyInArrow(run, schema)


class _Meeting(Reducer):
    """Pairs of balls that may hold neighbours."""

    schema = f"{LID} bigint, {RID} bigint, cc double, ri double, rj double, li double, lj double"

    def __init__(self, diagonal: bool):
        self.diagonal = diagonal

    def tile(self, d, left, right):
        (lr, ll, lo), (rr, rl, ro) = ([s[c].to_numpy() for c in ("radius", "limit", "only")] for s in (left, right))
        lid, rid = left[LID].to_numpy(), right[RID].to_numpy()
        # infinite and undefined radii exclude nothing
        with np.errstate(invalid="ignore"):
            apart = d - lr[:, None] - rr[None, :] > np.maximum(ll[:, None], rl[None, :])
        alike = (lo[:, None] == ro[None, :]) & (lo[:, None] >= 0)
        ordered = lid[:, None] <= rid[None, :] if self.diagonal else lid[:, None] < rid[None, :]
        a, b = np.nonzero(ordered & ~alike & ~apart)
        return pd.DataFrame({LID: lid[a], RID: rid[b], "cc": d[a, b], "ri": lr[a], "rj": rr[b], "li": ll[a], "lj": rl[b]})

    def merge(self, partial):
        return partial


def _assign(points: DataFrame, pivots: np.ndarray, metric: str) -> DataFrame:
    """``points`` with the number of their nearest pivot and its distance."""
    schema = T.StructType([*points.schema.fields, T.StructField("ball", T.StringType()), T.StructField("dc", T.DoubleType())])
    base = _BASE[metric]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            d = pairwise(base, _prepared(metric, _vectors(b.column("embedding"))), pivots)
            at = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([str(i) for i in at.tolist()]), pa.array(d[np.arange(len(at)), at], pa.float64())],
                [*b.schema.names, "ball", "dc"])

    return points.mapInArrow(run, schema)


def _pivot_vectors(points: DataFrame, count: int, metric: str) -> np.ndarray:
    """``count`` points with the smallest hashes: at most MAX_PIVOTS, MAX_PIVOT_BYTES."""
    rows = points.orderBy(F.xxhash64("id"), "id").limit(count).select("embedding").collect()
    return np.unique(_prepared(metric, np.array([r.embedding for r in rows], np.float64)), axis=0)


def _divide(points: DataFrame, centres: DataFrame, large: DataFrame, metric: str, block_rows: int, level: int):
    """Divide the balls of ``large (ball, n)`` by pivots of their own: new points and
    centres."""
    base = _BASE[metric]
    planned = points.join(large, "ball", "left")
    stay = planned.where("n is null").drop("n")
    chunk = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / CHUNK_ROWS))
    rows = planned.where("n is not null").withColumn("chunk", chunk).drop("dc")
    wanted = F.least(F.lit(MAX_PIVOTS), F.ceil(2 * F.col("n") / block_rows))
    # a hash of its own picks each pivot, so no ball is sorted
    picked = rows.where(F.pmod(F.xxhash64("id", F.lit(level)), F.col("n")) < wanted).select(
        "ball", "n", F.col("embedding").alias("pivot"), "id")
    copies = picked.select(F.col("ball").alias("of"), F.col("id").alias("pid"), "pivot", F.explode(
        F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / CHUNK_ROWS) - 1)).alias("for_chunk"))
    schema = T.StructType([f for f in points.schema.fields if f.name != "dc"] + [T.StructField("dc", T.DoubleType())])
    names = schema.names

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame(columns=names)
        left = left.drop(columns=["n", "chunk"])
        right = right.sort_values("pid")
        if not len(right):
            return left.assign(dc=np.inf)[names]
        d = pairwise(base, _prepared(metric, stack(left["embedding"])), _prepared(metric, stack(right["pivot"])))
        at = d.argmin(axis=1)
        name = [f"{level}:{i}" for i in right["pid"].tolist()]
        return left.assign(ball=[name[k] for k in at.tolist()], dc=d[np.arange(len(at)), at])[names]

    new = (rows.groupBy("ball", "chunk").cogroup(copies.groupBy("of", "for_chunk")).applyInPandas(run, schema))
    pivot = normalize("pivot") if metric in ("cosine", "faiss_cosine") else F.col("pivot")
    centre = picked.select(F.concat(F.lit(f"{level}:"), F.col("id")).alias("ball"), pivot.alias("centre"))
    return cut_lineage(stay.select(*names).unionByName(new)), cut_lineage(centres.unionByName(centre).dropDuplicates(["ball"]))


def ball_index(df: DataFrame, metric: str = "euclidean", id_col: str = "id", vec_col: str = "embedding",
               attrs=(), block_rows: int | None = None) -> BallIndex:
    """The index of ``df`` (ids distinct, vectors of one length)."""
    if metric not in _BASE:
        raise ValueError(f"no bounds between balls are known for the metric {metric}")
    spark = df.sparkSession
    block = int(block_rows or spark.conf.get("embedscope.pairs.blockRows", str(DEFAULT_BLOCK_ROWS)))
    pts = cut_lineage(df.select(F.col(id_col).cast("long").alias("id"),
                                F.col(vec_col).cast("array<double>").alias("embedding"), *attrs))
    n, dim = pts.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if n <= block:
        one = pts.withColumns({"ball": F.lit(0).cast("long"), "dc": F.lit(0.0)})
        ball = spark.range(1).select(F.col("id").alias("ball"), F.array().cast("array<double>").alias("centre"),
                                     F.lit(float("inf")).alias("radius"), F.lit(n).cast("long").alias("n"))
        return BallIndex(one, ball, metric, True, block)
    most = max(2, min(MAX_PIVOTS, MAX_PIVOT_BYTES // (8 * dim)))
    pivots = _pivot_vectors(pts, min(most, -(-2 * n // block)), metric)
    points = cut_lineage(_assign(pts, pivots, metric))
    # a row for each pivot
    sizes = {int(r.ball): r.n for r in points.groupBy("ball").agg(F.count(F.lit(1)).alias("n")).collect()}
    kept = [p for p in range(len(pivots)) if sizes.get(p, 0) >= min(LEAST_BALL, block)]
    if kept and len(kept) < len(pivots):
        pivots = pivots[kept]
        points = cut_lineage(_assign(pts, pivots, metric))
    centres = spark.createDataFrame([(str(i), p.tolist()) for i, p in enumerate(pivots)], "ball string, centre array<double>")
    for level in range(1, LEVELS):
        large = cut_lineage(points.groupBy("ball").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block))
        if large.isEmpty():
            break
        points, centres = _divide(points, centres, large, metric, block, level)
    # copies of a point stay together under any pivot: split what is still large by a hash
    sizes = points.groupBy("ball").agg(F.count(F.lit(1)).alias("n"), F.max("dc").alias("radius"),
                                       F.max(F.forall("embedding", lambda x: x == 0)).alias("zero"))
    sizes = cut_lineage(sizes.withColumn("parts", F.ceil(F.col("n") / block)).select(
        "ball", "parts", F.when(F.col("zero") & F.lit(metric in ("cosine", "faiss_cosine")), F.lit(float("inf")))
        .otherwise(F.col("radius")).alias("radius")))
    part = F.pmod(F.xxhash64("id", F.lit(LEVELS)), F.col("parts"))
    many = sizes.where("parts > 1").select("ball", "parts")
    points = points.join(many, "ball", "left").withColumn("part", F.coalesce(part, F.lit(0).cast("long"))).drop("parts")
    numbered = cut_lineage(sizes.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
                           .join(centres, "ball").withColumn("number", F.monotonically_increasing_id()))
    points = cut_lineage(points.join(numbered.select("ball", "part", "number"), ["ball", "part"]).select(
        "id", "embedding", *attrs, F.col("number").alias("ball"), "dc"))
    balls = points.groupBy("ball").agg(F.count(F.lit(1)).alias("n")).join(
        numbered.select(F.col("number").alias("ball"), F.col("centre"), "radius"), "ball")
    return BallIndex(points, cut_lineage(balls.select("ball", "centre", "radius", "n")), metric, False, block)


# ------------------------------------------------------------------ searches

def count_within(index: BallIndex, eps_list) -> DataFrame:
    """``(id, counts array<bigint>)``: points within each eps, the point itself
    included."""
    eps = [float(e) for e in eps_list]

    def tile(d, left, right, diagonal):
        inside = [d <= e for e in eps]
        out = [pd.DataFrame({"id": left["id"].to_numpy(), **{f"c{k}": m.sum(axis=1) for k, m in enumerate(inside)}})]
        if not diagonal:
            out.append(pd.DataFrame({"id": right["id"].to_numpy(), **{f"c{k}": m.sum(axis=0) for k, m in enumerate(inside)}}))
        return pd.concat(out, ignore_index=True)

    cols = [f"c{k}" for k in range(len(eps))]
    found = index.reduce(index.tiles(search_limit(index.metric, max(eps))), tile,
                         "id long, " + ", ".join(f"{c} long" for c in cols),
                         combine=lambda rows: rows.groupby("id", as_index=False).sum())
    return found.groupBy("id").agg(F.array(*[F.sum(c) for c in cols]).alias("counts"))


def nearest(index: BallIndex, k: int) -> DataFrame:
    """``(id, other, d, nn)``, the ``k`` nearest points of each point, itself the
    first; fewer where there are fewer."""
    if k <= 0:
        raise ValueError("top_k must be positive")
    schema = "id long, other long, d double"

    def least(ids, others, d, bound):
        """The k smallest of each row of ``d`` that are within the row's bound."""
        kk = min(k, d.shape[1])
        d = np.where(np.isnan(d), np.inf, d)
        at = np.argpartition(d, kk - 1, axis=1)[:, :kk] if kk < d.shape[1] else \
            np.broadcast_to(np.arange(kk), (len(d), kk))
        rows = np.repeat(np.arange(len(d)), kk)
        at = at.reshape(-1)
        v = d[rows, at]
        keep = np.isfinite(v) if bound is None else np.isfinite(v) & (v <= bound[rows])
        return pd.DataFrame({"id": ids[rows][keep], "other": others[at][keep], "d": v[keep]})

    def own(d, left, right, diagonal):
        ids = left["id"].to_numpy()
        return least(ids, ids, d, None)

    def fewer(rows):
        rows = rows.sort_values(["id", "d", "other"])
        return rows[rows.groupby("id").cumcount() < k]

    first = index.reduce(_diagonal(index), own, schema, alone=True)
    if index.single:
        return _k_first(first, k)
    first = cut_lineage(first)
    bound = first.groupBy("id").agg(F.count(F.lit(1)).alias("have"), F.max("d").alias("d")).select(
        "id", F.when(F.col("have") >= k, F.col("d")).otherwise(F.lit(float("inf"))).alias("bound"))
    points = cut_lineage(index.points.join(bound, "id").withColumn("reach", search_limit(index.metric, F.col("bound"))))
    limits = points.groupBy("ball").agg(F.max("reach").alias("limit"))

    def other(d, left, right, diagonal):
        a, b = left["id"].to_numpy(), right["id"].to_numpy()
        return pd.concat([least(a, b, d, left["bound"].to_numpy()),
                          least(b, a, d.T, right["bound"].to_numpy())], ignore_index=True)

    more = index.with_points(points).reduce(index.tiles(limits, diagonal=False), other, schema,
                                            attrs=("bound", "reach"), own_limit="reach", combine=fewer)
    return _k_first(first.unionByName(more), k)


def _k_first(rows: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window
    w = Window.partitionBy("id").orderBy("d", "other")
    return rows.withColumn("nn", F.row_number().over(w)).where(F.col("nn") <= k)


def forests_within(index: BallIndex, eps_list, flag_col: str = "core") -> tuple[DataFrame, DataFrame | None]:
    """Components of the points flagged in the boolean array column, an element for
    each eps, as far as tiles see them.

    First ``(cfg, id, root, is_core)``: a flagged point with the smallest point of its
    component in its ball, another point with each such root that it touches.  Then
    ``(cfg, a, b)``: roots of one component (None if there is one ball)."""
    eps = [float(e) for e in eps_list]

    def flags(side, n):
        return np.array(side[flag_col].tolist(), bool).reshape(n, -1)

    def own(d, left, right, diagonal):
        ids = left["id"].to_numpy()
        core = flags(left, len(ids))
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))  # the smallest id has the smallest place
        out = []
        for c, e in enumerate(eps):
            near = d <= e
            at = np.flatnonzero(core[:, c])
            src, dst = np.nonzero(near[np.ix_(at, at)])
            lab = order[components(len(ids), place[at[src]], place[at[dst]])[place]]
            out.append(pd.DataFrame({"cfg": c, "id": ids[at], "root": ids[lab[at]], "is_core": True}))
            out.append(_touched(c, ids, near & ~core[:, c][:, None] & core[:, c][None, :], ids[lab]))
        return pd.concat(out, ignore_index=True)

    def runs(core, root):
        """The flagged rows root by root, where each root starts, and the roots."""
        at = np.flatnonzero(core)
        at = at[np.argsort(root[at], kind="stable")]
        names, starts = np.unique(root[at], return_index=True)
        return at, starts, names

    def other(d, left, right, diagonal):
        a, b = left["id"].to_numpy(), right["id"].to_numpy()
        core_a, core_b = flags(left, len(a)), flags(right, len(b))
        root_a, root_b = (np.array(x["roots"].tolist(), np.int64).reshape(len(x), -1) for x in (left, right))
        found = []

        def add(c, ids, roots, is_core):
            if len(ids):
                found.append((np.full(len(ids), c), ids, roots, np.full(len(ids), is_core)))

        for c, e in enumerate(eps):
            near = d <= e
            fa, fb = core_a[:, c], core_b[:, c]
            (at_a, from_a, of_a), (at_b, from_b, of_b) = runs(fa, root_a[:, c]), runs(fb, root_b[:, c])
            if len(of_b):  # rows by roots of the other side
                met = near.any(axis=1)[:, None] if len(of_b) == 1 and fb.all() else \
                    np.logical_or.reduceat(near[:, at_b], from_b, axis=1)
                if len(of_a):
                    p, q = np.nonzero(np.logical_or.reduceat(met[at_a], from_a, axis=0))
                    pairs = np.stack([of_a[p], of_b[q]], axis=1)
                    names, inv = np.unique(pairs, return_inverse=True)
                    inv = inv.reshape(pairs.shape)
                    lab = components(len(names), inv[:, 0], inv[:, 1])
                    far = np.flatnonzero(lab != np.arange(len(names)))
                    add(c, names[far], names[lab[far]], True)
                p, q = np.nonzero(met[~fa])
                add(c, a[~fa][p], of_b[q], False)
            if len(of_a) and not fb.all():
                p, q = np.nonzero(np.logical_or.reduceat(near[np.ix_(at_a, ~fb)], from_a, axis=0).T)
                add(c, b[~fb][p], of_a[q], False)
        columns = [np.concatenate(x) for x in zip(*found)] if found else [[]] * 4
        return pd.DataFrame(dict(zip(("cfg", "id", "root", "is_core"), columns)))

    schema = "cfg int, id long, root long, is_core boolean"
    limit = search_limit(index.metric, max(eps))
    first = cut_lineage(index.reduce(_diagonal(index), own, schema, attrs=(flag_col,), alone=True))
    if index.single:
        return first, None
    roots = first.where("is_core").groupBy("id").agg(F.array(*[
        F.coalesce(F.max(F.when(F.col("cfg") == c, F.col("root"))), F.lit(0)) for c in range(len(eps))]).alias("roots"))
    none = F.array(*[F.lit(0).cast("long")] * len(eps))
    points = cut_lineage(index.points.join(roots, "id", "left").withColumn("roots", F.coalesce("roots", none)))
    more = cut_lineage(index.with_points(points).reduce(index.tiles(limit, diagonal=False), other, schema,
                                                        attrs=(flag_col, "roots"),
                                                        combine=lambda rows: rows.drop_duplicates()))
    return (first.unionByName(more.where("not is_core")),
            more.where("is_core").select("cfg", F.col("id").alias("a"), F.col("root").alias("b")).distinct())


def _touched(cfg: int, ids: np.ndarray, near: np.ndarray, roots: np.ndarray) -> pd.DataFrame:
    p, q = np.nonzero(near)
    pairs = np.unique(np.stack([ids[p], roots[q]], axis=1), axis=0)
    return pd.DataFrame({"cfg": cfg, "id": pairs[:, 0], "root": pairs[:, 1], "is_core": False})


def _diagonal(index: BallIndex) -> DataFrame:
    """Each ball with itself."""
    return index.balls.select(*[F.col("ball").alias(c) for c in "ij"], F.lit(0.0).alias("cc"),
                              *[F.col("radius").alias(c) for c in ("ri", "rj")],
                              *[F.lit(0.0).alias(c) for c in ("li", "lj")])
