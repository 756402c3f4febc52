"""Tiled pair kernel: exact all-pairs work without emitting pairs.

Every operator whose cost is "each vector against many vectors" (corpus
kNN, range neighbours for DBSCAN, silhouette sums, pairs inside a prompt's
responses, nearest centre) runs through :func:`pair_reduce`.

Plan:

1. Count rows: of both sides where there are no groups (two numbers, literals
   in the plan, so no join), else per group (a written table).
2. Split each group into blocks by a hash of the row id: about ``BLOCKS`` of them
   a side whatever the number of rows, so that each row is copied so many times, and
   more only where a block would hold more than ``BLOCK_BYTES`` of vectors.  A group
   that holds a third of all rows simply gets many blocks; a tiny group gets one.  The ungrouped case is one group whose
   left side is also split up to the available task slots.  Only the groups of
   several blocks are joined to the rows: broadcast up to
   ``PLAN_BROADCAST_ROWS`` of them, else by a salted key, so that a hot group
   is never one task.
3. Replicate each left row to the right blocks of its group and each right
   row to the left blocks (an equi-join key ``(group, lb, rb)``, never a
   cartesian product of rows), then ``cogroup(...).applyInPandas`` per tile.
4. Inside the tile NumPy matrix products give the distances, some left rows
   (``CHUNK_PAIRS``) at a time; a *reducer* turns it into small partial rows (top-k per row, sums per
   label, counts within eps, a spanning forest, pair statistics).
5. Partials are merged with an ordinary aggregate / window.

Memory per task is bounded by two blocks and a chunk, whatever the skew,
and no row of the output grows with the number of pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from embedscope.functions.kernels import group_pairs, nearest_manhattan, pairwise, rowwise, stack
from embedscope.session import cut_lineage, default_parallelism

G, LID, RID, VEC, LB, RB, BK = "__g", "__lid", "__rid", "__v", "__lb", "__rb", "__bk"

DEFAULT_BLOCK_ROWS = 2048
# Blocks a side where no number of rows is given, and the bytes of vectors in one.
BLOCKS = 10
BLOCK_BYTES = 32 << 20
# Pairs whose distances are held at a time.
CHUNK_PAIRS = 1 << 20
# Groups with at most this many pairs in a tile take the vectorised path.
SMALL_GROUP_PAIRS = 4096
# Block plans (three numbers a group) up to this many rows are broadcast.
PLAN_BROADCAST_ROWS = 100_000
PLAN_SALTS = 64
# Tiles, where up to this many get a partition of their own.
OWN_PARTITIONS = 2000


def even_keys(spark, count: int) -> list[int]:
    """``count`` keys that Spark's hash deals to as many partitions, one each (as far as
    the keys tried go)."""
    tried = spark.range(64 * count).select("id", F.pmod(F.hash("id"), F.lit(count)).alias("p"))
    keys = {r.p: r.id for r in tried.groupBy("p").agg(F.min("id").alias("id")).collect()}
    return [keys.get(p, -1 - p) for p in range(count)]


class Reducer:
    """Turns one distance tile into partial rows, and merges partials."""

    schema: str = ""

    def tile(self, d: np.ndarray, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def tile_vectors(self, metric: str, a: np.ndarray, b: np.ndarray, left: pd.DataFrame,
                     right: pd.DataFrame) -> pd.DataFrame | None:
        """The same from the vectors themselves, where the reducer has a shorter way."""
        return None

    def merge(self, partial: DataFrame) -> DataFrame:
        raise NotImplementedError


class TopK(Reducer):
    """k smallest distances per left row: ``(lid, rid, d, nn)``, nn = 1..k.

    Undefined distances (NaN, e.g. raw cosine with a zero vector) are
    treated as absent.
    """

    def __init__(self, k: int):
        if k <= 0:
            raise ValueError("top_k must be positive")
        self.k = k
        self.schema = f"{LID} bigint, {RID} bigint, d double"

    def tile(self, d, left, right):
        if d.shape[1] == 0:
            return pd.DataFrame({LID: [], RID: [], "d": []})
        d = np.where(np.isnan(d), np.inf, d)
        kk = min(self.k, d.shape[1])
        if kk < d.shape[1]:
            idx = np.argpartition(d, kk - 1, axis=1)[:, :kk]
        else:
            idx = np.broadcast_to(np.arange(d.shape[1]), d.shape)
        rows = np.repeat(np.arange(d.shape[0]), idx.shape[1])
        cols = idx.reshape(-1)
        vals = d[rows, cols]
        keep = np.isfinite(vals)
        return pd.DataFrame({
            LID: left[LID].to_numpy()[rows][keep],
            RID: right[RID].to_numpy()[cols][keep],
            "d": vals[keep],
        })

    def tile_vectors(self, metric, a, b, left, right):
        """The rows of :meth:`tile` where the distances of most pairs need not be exact."""
        if metric != "manhattan" or len(b) <= 4 * self.k:
            return None
        rows, cols, vals = nearest_manhattan(a, b, self.k)
        return pd.DataFrame({LID: left[LID].to_numpy()[rows], RID: right[RID].to_numpy()[cols], "d": vals})

    def merge(self, partial):
        w = Window.partitionBy(G, LID).orderBy(F.col("d"), F.col(RID))
        return (partial.withColumn("nn", F.row_number().over(w))
                .where(F.col("nn") <= self.k))


class LabelSums(Reducer):
    """Per left row and right label: sum of distances and count of rows."""

    def __init__(self, label_col: str):
        self.label_col = label_col
        self.schema = f"{LID} bigint, label bigint, sum_d double, n bigint"

    def tile(self, d, left, right):
        labels = right[self.label_col].to_numpy().astype(np.int64)
        uniq, inv = np.unique(labels, return_inverse=True)
        onehot = np.zeros((len(labels), len(uniq)))
        onehot[np.arange(len(labels)), inv] = 1.0
        sums = d @ onehot
        counts = onehot.sum(axis=0).astype(np.int64)
        nl = d.shape[0]
        return pd.DataFrame({
            LID: np.repeat(left[LID].to_numpy(), len(uniq)),
            "label": np.tile(uniq, nl),
            "sum_d": sums.reshape(-1),
            "n": np.tile(counts, nl),
        })

    def merge(self, partial):
        return partial.groupBy(G, LID, "label").agg(
            F.sum("sum_d").alias("sum_d"), F.sum("n").alias("n"))


class CountWithin(Reducer):
    """Per left row: number of right rows with ``d <= eps`` (itself included
    when it is on the right side)."""

    def __init__(self, eps: float):
        self.eps = float(eps)
        self.schema = f"{LID} bigint, n bigint"

    def tile(self, d, left, right):
        return pd.DataFrame({LID: left[LID].to_numpy(),
                             "n": (d <= self.eps).sum(axis=1).astype(np.int64)})

    def merge(self, partial):
        return partial.groupBy(G, LID).agg(F.sum("n").alias("n"))


class PairStats(Reducer):
    """Per group: count, sum, sum of squares, min and max of the distances
    over ordered pairs of distinct ids."""

    schema = "n bigint, s double, ss double, mn double, mx double"

    def tile(self, d, left, right):
        mask = left[LID].to_numpy()[:, None] != right[RID].to_numpy()[None, :]
        vals = d[mask]
        if vals.size == 0:
            return pd.DataFrame({"n": [], "s": [], "ss": [], "mn": [], "mx": []})
        return pd.DataFrame({"n": [vals.size], "s": [vals.sum()], "ss": [(vals * vals).sum()],
                             "mn": [vals.min()], "mx": [vals.max()]})

    def tile_pairs(self, codes, d, lids, rids):
        """Many small groups at once: ``codes`` is the group code of each
        pair, ``d`` its distance."""
        keep = lids != rids
        codes, d = codes[keep], d[keep]
        if d.size == 0:
            return None
        k = int(codes.max()) + 1
        n = np.bincount(codes, minlength=k)
        s = np.bincount(codes, weights=d, minlength=k)
        ss = np.bincount(codes, weights=d * d, minlength=k)
        mn = np.full(k, np.inf)
        mx = np.full(k, -np.inf)
        np.minimum.at(mn, codes, d)
        np.maximum.at(mx, codes, d)
        has = n > 0
        return np.nonzero(has)[0], {"n": n[has].astype(np.int64), "s": s[has], "ss": ss[has],
                                    "mn": mn[has], "mx": mx[has]}

    def merge(self, partial):
        return partial.groupBy(G).agg(
            F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"),
            F.min("mn").alias("mn"), F.max("mx").alias("mx"))


def _side(df: DataFrame, id_col: str, vec_col: str, group_col, attrs, id_name: str) -> DataFrame:
    g = F.col(group_col) if group_col else F.lit(0).cast("bigint")
    return df.select(g.alias(G), F.col(id_col).cast("bigint").alias(id_name),
                     F.col(vec_col).cast("array<double>").alias(VEC),
                     *[F.col(a).alias(a) for a in attrs])


def _block_rows(n: int, most: int | None, dim: int) -> int:
    """Rows of a block of ``n`` rows: ``most`` if given, else by the number of blocks."""
    if most:
        return most
    return max(DEFAULT_BLOCK_ROWS, min(-(-n // BLOCKS), BLOCK_BYTES // (8 * max(1, dim or 1))))


def _planned(rows: DataFrame, several: DataFrame, id_name: str, few: bool) -> DataFrame:
    """``rows`` with the numbers of blocks of their group (1 where the plan has none)."""
    if few:
        joined = rows.join(F.broadcast(several), G, "left")
    else:
        salted = several.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(PLAN_SALTS - 1))))
        joined = (rows.withColumn("__salt", F.pmod(F.xxhash64(id_name), F.lit(PLAN_SALTS)).cast("int"))
                  .join(salted.hint("merge"), [G, "__salt"], "left").drop("__salt"))
    one = F.lit(1)
    return joined.withColumns({"__nlb": F.coalesce("__nlb", one), "__nrb": F.coalesce("__nrb", one)})


def pair_reduce(left: DataFrame, right: DataFrame, reducer: Reducer, *, metric: str,
                id_col: str = "id", vec_col: str = "embedding", right_id_col: str | None = None,
                right_vec_col: str | None = None, group_col: str | None = None,
                lattrs=(), rattrs=(), same_ids: bool = False,
                block_rows: int | None = None, left_floor: int | None = None) -> DataFrame:
    """Run ``reducer`` over all (left, right) pairs inside each group.

    Returns the reducer's merged output with the group column named
    ``__g`` (a constant 0 when ``group_col`` is None).  ``same_ids`` says
    both sides share one id space, so a row met with itself gets distance 0.

    Grouped work is packed: small groups share a tile (the tile key is a
    hash bucket of the group, with ``total rows / block_rows`` buckets), and
    a group larger than a block is split into blocks of its own.  A tile
    therefore holds about ``block_rows`` rows per side (or what ``_block_rows`` gives),
    whatever the mix of many tiny groups and a few huge ones.
    """
    spark = left.sparkSession
    most = int(block_rows or spark.conf.get("embedscope.pairs.blockRows", "0"))
    block = most or DEFAULT_BLOCK_ROWS
    lft = _side(left, id_col, vec_col, group_col, lattrs, LID)
    rgt = _side(right, right_id_col or id_col, right_vec_col or vec_col, group_col, rattrs, RID)
    gtype = lft.schema[G].dataType.simpleString()
    floor = left_floor or (1 if group_col else default_parallelism(spark))

    if group_col:
        lft, rgt = lft.where(F.col(G).isNotNull()), rgt.where(F.col(G).isNotNull())
        counts = cut_lineage(lft.groupBy(G).agg(F.count(F.lit(1)).alias("__nl"), F.max(F.size(VEC)).alias("__dim"))
                             .join(rgt.groupBy(G).agg(F.count(F.lit(1)).alias("__nr")), G))
        total, dim = counts.agg(F.sum("__nl"), F.max("__dim")).first()
        total = total or 0
        widest = BLOCK_BYTES // (8 * max(1, dim or 1))

        def blocks(n: str):
            of = F.lit(most) if most else F.greatest(F.lit(block), F.least(F.ceil(F.col(n) / BLOCKS), F.lit(widest)))
            return F.ceil(F.col(n) / of)

        keys = [BK, LB, RB]
        bucket = F.pmod(F.xxhash64(G), F.lit(max(1, -(-total // block)))).cast("int")
        several = cut_lineage(counts.select(
            G, F.greatest(blocks("__nl"), F.least(F.col("__nl"), F.lit(floor))).cast("int").alias("__nlb"),
            blocks("__nr").cast("int").alias("__nrb")).where("__nlb > 1 or __nrb > 1"))
        few = several.count() <= PLAN_BROADCAST_ROWS
        lx, rx = _planned(lft, several, LID, few), _planned(rgt, several, RID, few)
    else:
        nl, dim = lft.agg(F.count(F.lit(1)), F.max(F.size(VEC))).first()
        nr = nl if left is right else rgt.count()
        keys, bucket = [LB, RB], F.lit(0)
        nlb, nrb = (max(1, -(-n // _block_rows(n, most, dim))) for n in (nl, nr))
        sizes = {"__nlb": F.lit(max(nlb, min(nl, floor))), "__nrb": F.lit(nrb)}
        lx, rx = lft.withColumns(sizes), rgt.withColumns(sizes)

    lx = (lx.withColumn(LB, F.pmod(F.xxhash64(LID), F.col("__nlb")).cast("int"))
          .withColumn(RB, F.explode(F.sequence(F.lit(0), F.col("__nrb") - 1)))
          .withColumn(BK, bucket).drop("__nlb", "__nrb"))
    rx = (rx.withColumn(RB, F.pmod(F.xxhash64(RID), F.col("__nrb")).cast("int"))
          .withColumn(LB, F.explode(F.sequence(F.lit(0), F.col("__nlb") - 1)))
          .withColumn(BK, bucket).drop("__nlb", "__nrb"))

    red = reducer
    out_cols = [G] + [c.split()[0] for c in red.schema.split(", ")]

    def one_group(g, lpdf: pd.DataFrame, rpdf: pd.DataFrame) -> pd.DataFrame:
        a, b = stack(lpdf[VEC]), stack(rpdf[VEC])
        out = red.tile_vectors(metric, a, b, lpdf, rpdf) if not same_ids else None
        if out is None:
            lpdf, rpdf = lpdf.drop(columns=VEC), rpdf.drop(columns=VEC)
            lid, rid = lpdf[LID].to_numpy(), rpdf[RID].to_numpy()
            step = max(1, CHUNK_PAIRS // max(1, len(b)))
            met = np.isin(lid, rid) if same_ids else np.zeros(len(lid), bool)
            outs = []
            for s in range(0, len(a), step):
                d = pairwise(metric, a[s:s + step], b)
                for k in np.flatnonzero(met[s:s + step]):
                    d[k, rid == lid[s + k]] = 0.0
                outs.append(red.tile(d, lpdf.iloc[s:s + step], rpdf))
            some = [x for x in outs if len(x)]
            out = outs[0] if not some else some[0] if len(some) == 1 else pd.concat(some, ignore_index=True)
        out.insert(0, G, g)
        return out

    def run_tile(key, lpdf: pd.DataFrame, rpdf: pd.DataFrame) -> pd.DataFrame:
        if len(lpdf) == 0 or len(rpdf) == 0:
            return pd.DataFrame(columns=out_cols)
        if not group_col:
            return one_group(lpdf[G].iloc[0], lpdf.reset_index(drop=True), rpdf.reset_index(drop=True))
        outs = []
        if hasattr(red, "tile_pairs"):
            # small groups: form the within-group pairs by index arithmetic and
            # reduce them in one vectorised pass; big groups use the matrix path
            keys, lcodes = np.unique(lpdf[G].to_numpy(), return_inverse=True)
            rpos = np.searchsorted(keys, rpdf[G].to_numpy())
            rpos = np.clip(rpos, 0, len(keys) - 1)
            rcodes = np.where(keys[rpos] == rpdf[G].to_numpy(), rpos, -1)
            nl = np.bincount(lcodes, minlength=len(keys))
            nr = np.bincount(rcodes[rcodes >= 0], minlength=len(keys))
            small = (nl * nr) <= SMALL_GROUP_PAIRS
            lmask, rmask = small[lcodes], (rcodes >= 0) & small[np.maximum(rcodes, 0)]
            if lmask.any() and rmask.any():
                li, ri = group_pairs(lcodes[lmask], rcodes[rmask])
                lsel, rsel = np.nonzero(lmask)[0][li], np.nonzero(rmask)[0][ri]
                a, b = stack(lpdf[VEC]), stack(rpdf[VEC])
                d = rowwise(metric, a[lsel], b[rsel])
                lids, rids = lpdf[LID].to_numpy()[lsel], rpdf[RID].to_numpy()[rsel]
                if same_ids:
                    d = np.where(lids == rids, 0.0, d)
                res = red.tile_pairs(lcodes[lsel], d, lids, rids)
                if res is not None:
                    idx, cols = res
                    part = pd.DataFrame(cols)
                    part.insert(0, G, keys[idx])
                    outs.append(part)
            big = set(keys[~small].tolist())
        else:
            big = None
        rparts = {g: sub.reset_index(drop=True) for g, sub in rpdf.groupby(G, sort=False)
                  if big is None or g in big}
        outs += [one_group(g, sub.reset_index(drop=True), rparts[g])
                 for g, sub in lpdf.groupby(G, sort=False) if g in rparts]
        if not outs:
            return pd.DataFrame(columns=out_cols)
        return pd.concat(outs, ignore_index=True)

    partial = (lx.groupBy(*keys).cogroup(rx.groupBy(*keys))
               .applyInPandas(run_tile, schema=f"{G} {gtype}, {red.schema}"))
    return red.merge(partial)
