"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source's words, in an order fixed by hashes, form one stream that is cut
into blocks of ``block_words`` words.  A source's target gives its exact quota
of blocks.  The vector of quotas is split down a binary tree over the output
shards: at each node the left half of the shards receives a multivariate
hypergeometric draw of the node's blocks, drawn source after source by inversion
of the hypergeometric distribution, and the right half the rest.  Each shard so
gets an exact number of blocks of every source, and all shards are equally large.

The blocks of a source are permuted, once for each pass over the source, by a
keyed bijection that each row computes for itself; shard after shard takes the
next blocks of that sequence, so the shards' draws are disjoint.  ``place`` is
the hash that shuffles a shard's pieces: ``mix_shards`` gives the pieces with
their texts in that order, ``write_mix`` writes them shard by shard.

DataFrame and SQL functions only.  All random choices are hashes of the seed, so
reruns agree.  The vector of quotas travels as one array: a few bytes for each
source and tree node.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from embedscope.llm.blocknames import dense_names
from embedscope.llm.work import Cuts, row_keyed, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
BLOCK_WORDS = 128
SHARDS = 32
SEED = 20
ROUNDS = 16
BUCKET_ROWS = 20_000
FILE_WORDS = 8_000_000

_SPACE = r"\\x20\\x09-\\x0D"


def _log_factorial(n: str) -> str:
    """ln n! of a double expression: exact below 16, Stirling's series above."""
    big = f"greatest({n}, 16D)"
    return (f"(case when {n} < 16 then ln(factorial(cast({n} as int))) else "
            f"({big} + 0.5D) * ln({big}) - {big} + 0.9189385332046727D + 1 / (12 * {big}) "
            f"- 1 / (360 * pow({big}, 3)) + 1 / (1260 * pow({big}, 5)) end)")


def _log_choose(n: str, k: str) -> str:
    return f"({_log_factorial(n)} - {_log_factorial(k)} - {_log_factorial(f'({n} - {k})')})"


def hypergeometric(u: str, good: str, bad: str, draws: str) -> str:
    """SQL: the number of good ones among ``draws`` of ``good + bad``, by
    inversion of the uniform ``u`` outwards from the mode.

    The walk covers ten standard deviations to either side; the mass beyond is
    below the resolution of a double.
    """
    pop = "(p.good + p.bad)"
    mode = f"floor((p.draws + 1) * (p.good + 1) / ({pop} + 2))"
    steps = (f"cast(least(p.good, p.draws, 20 + ceil(10 * sqrt(p.draws * (p.good / greatest({pop}, 1D)) "
             f"* (p.bad / greatest({pop}, 1D)) + 1))) as int)")
    at_mode = (f"exp({_log_choose('p.good', 'p.m')} + {_log_choose('p.bad', '(p.draws - p.m)')} "
               f"- {_log_choose(pop, 'p.draws')})")
    up = "s.pu * ((p.good - s.ku) * (p.draws - s.ku) / ((s.ku + 1) * (p.bad - p.draws + s.ku + 1)))"
    down = "s.pd * (s.kd * (p.bad - p.draws + s.kd) / ((p.good - s.kd + 1) * (p.draws - s.kd + 1)))"
    walk = f"""aggregate(
        if({steps} < 1, array(), sequence(1, {steps})),
        named_struct('u', p.u - p.pm, 'ku', p.m, 'pu', p.pm, 'kd', p.m, 'pd', p.pm,
                     'k', if(p.u < p.pm, p.m, -1D)),
        (s, i) -> if(s.k >= 0, s, element_at(transform(
            array(named_struct('up', {up}, 'down', {down})),
            v -> named_struct('u', s.u - v.up - v.down, 'ku', s.ku + 1, 'pu', v.up, 'kd', s.kd - 1, 'pd', v.down,
                              'k', case when s.u < v.up then s.ku + 1
                                        when s.u < v.up + v.down then s.kd - 1 else -1D end)), 1)),
        s -> if(s.k >= 0, s.k, p.m))"""
    first = f"named_struct('u', {u}, 'good', {good}, 'bad', {bad}, 'draws', {draws})"
    moded = (f"transform(array({first}), p -> named_struct('u', p.u, 'good', p.good, 'bad', p.bad, "
             f"'draws', p.draws, 'm', cast(least(p.good, p.draws, {mode}) as double)))")
    massed = (f"transform({moded}, p -> named_struct('u', p.u, 'good', p.good, 'bad', p.bad, "
              f"'draws', p.draws, 'm', p.m, 'pm', {at_mode}))")
    return f"element_at(transform({massed}, p -> {walk}), 1)"


def split_tree(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """``(shard, idx, n)``: blocks of source ``idx`` for each shard, from ``(idx, q)``.

    Per source the shards' numbers add up to ``q``; the shards' sums differ by
    at most one block for each level of the tree.
    """
    node = quotas.agg(F.sort_array(F.collect_list(F.struct(
        F.col("idx").cast("long").alias("idx"), F.col("q").cast("double").alias("q")))).alias("v")).select(
        F.lit(0).alias("lo"), F.lit(shards).alias("n"), "v")
    total = "aggregate(v, 0D, (a, x) -> a + x.q)"
    uniform = f"(shiftrightunsigned(xxhash64({seed}, lo, n, x.idx), 11) / 9007199254740992D)"
    draw = hypergeometric(uniform, "x.q", "(a.pop - x.q)", "a.draws")
    left = f"""aggregate(v,
        named_struct('pop', total, 'draws', floor(total * div_half / n) * 1D,
                     'left', cast(array() as array<struct<idx: bigint, q: double>>)),
        (a, x) -> element_at(transform(array({draw}), h -> named_struct(
            'pop', a.pop - x.q, 'draws', a.draws - h,
            'left', array_append(a.left, named_struct('idx', x.idx, 'q', h)))), 1),
        a -> a.left)"""
    levels = max(0, (shards - 1).bit_length())
    for _ in range(levels):
        halves = (node.withColumn("total", F.expr(total)).withColumn("div_half", F.expr("n div 2"))
                  .withColumn("left", F.expr(f"if(n > 1, {left}, v)")))
        node = halves.select(F.explode(F.expr("""if(n > 1, array(
            named_struct('lo', lo, 'n', cast(div_half as int), 'v', left),
            named_struct('lo', cast(lo + div_half as int), 'n', cast(n - div_half as int), 'v',
                zip_with(v, left, (x, y) -> named_struct('idx', x.idx, 'q', x.q - y.q)))),
            array(named_struct('lo', lo, 'n', n, 'v', v)))""")).alias("c")).select("c.*")
    return node.select(F.col("lo").alias("shard"), F.explode("v").alias("x")).select(
        "shard", "x.idx", F.col("x.q").cast("long").alias("n"))


def _permuted(block: str, n: str, keys: str) -> str:
    """SQL: the place of ``block`` in a keyed permutation of ``0 .. n-1``.

    Swap-or-not rounds: each round pairs x with k - x (mod n) and swaps the
    two if a hash bit of the pair says so; a bijection for every n.
    """
    other = f"if(k.k >= x, k.k - x, k.k - x + {n})"
    return f"""aggregate({keys}, cast({block} as bigint),
        (x, k) -> if(xxhash64(k.s, greatest(x, {other})) % 2 = 0, x, {other}))"""


def source_targets(sized: DataFrame, cuts: Cuts, weights=WEIGHTS, share: float = SHARE,
                   cap: float = CAP) -> DataFrame:
    """``(source, idx, source_size, n_docs, target)`` per source.

    The level ``share of words / weight`` is raised until the targets,
    ``least(cap * size, level * weight)``, add up to the share; each round reads
    two sums.
    """
    sums = cuts.cut(sized.groupBy("source").agg(F.sum("size").alias("source_size"),
                                                F.count(F.lit(1)).alias("n_docs")))
    order = dense_names(sums.select(F.col("source").isNull().alias("last"), "source"), cuts)
    per = sums.join(order, sums.source.eqNullSafe(order.source)).select(
        sums.source, F.col("name").alias("idx"), "source_size", "n_docs",
        F.element_at(F.array(*[F.lit(w) for w in weights]),
                     (F.col("name") % len(weights) + 1).cast("int")).alias("weight"))
    per = cuts.cut(per)
    total = share * (per.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        full = F.col("source_size") * cap <= level * F.col("weight")
        capped, open_weight = per.agg(
            F.coalesce(F.sum(F.when(full, F.col("source_size") * cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        raised = (total - capped) / open_weight if open_weight else level
        if raised <= level:
            break
        level = raised
    return per.withColumn("target", F.least(F.col("source_size") * cap, F.lit(level) * F.col("weight")))


def mix(docs: DataFrame, keys: list[str], cuts: Cuts, weights=WEIGHTS, share: float = SHARE, cap: float = CAP,
        block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``(*keys, doc_id, source, size, source_size, target, pieces)`` per row of ``docs``.

    ``pieces`` holds the parts that the mix takes: ``pass, block, shard, place,
    first, words`` (``first``: words of the document before the part).  A null
    text has size 0; rows of size 0 are taken nowhere; a null source is a source
    and comes last.  Rows are ordered by hashes of id and text, so rows that
    repeat both are interchangeable.  An empty table gives an empty result.
    """
    sized = cuts.cut(docs.select(
        *keys, "doc_id", "source",
        F.expr(f"coalesce(cast(regexp_count(text, '[^{_SPACE}]+') as bigint), 0L)").alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("__h")))
    targets = source_targets(sized, cuts, weights, share, cap)
    # blocks of each source, and its quota: whole passes and the rest in blocks
    words = "cast(round(target) as bigint)"
    most = max(1, math.ceil(cap))  # passes over a source: targets stop at cap times its size
    passes = f"({words} div greatest(source_size, 1L))"
    targets = targets.withColumn("blocks", F.expr(f"cast(ceil(source_size / {block_words}D) as bigint)")).withColumn(
        "q", F.expr(f"{passes} * blocks + cast(round(({words} - {passes} * source_size) / {block_words}D) as bigint)"))
    targets = cuts.cut(targets)
    ends = split_tree(targets.select("idx", "q"), shards, seed).groupBy("idx").agg(
        F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("given"))  # `shards` entries for a source
    targets = cuts.cut(targets.join(ends, "idx").select(
        "source", "source_size", "target", "blocks",
        F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BUCKET_ROWS)).cast("long").alias("buckets"),
        # tickets that have been dealt after each shard
        F.expr("transform(given, (g, i) -> aggregate(slice(given, 1, i + 1), 0L, (a, x) -> a + x.n))").alias("ends"),
        *[F.expr(f"transform(sequence(1, {ROUNDS}), r -> named_struct('k', pmod(xxhash64({seed}, idx, {e}, r), "
                 f"greatest(blocks, 1L)), 's', xxhash64({seed}, idx, {e}, r, 1)))").alias(f"keys{e}")
          for e in range(most)]))

    rows = sized.join(targets.select(F.col("source").alias("__s"), "buckets"),
                      F.col("source").eqNullSafe(F.col("__s"))).drop("__s").withColumn(
        "bucket", F.expr("pmod(__h, buckets)"))
    # prefix sums in two steps: inside a bucket of some rows, and over a source's buckets
    inside = Window.partitionBy("source", "bucket").orderBy("__h", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("__b")).select(
        F.col("source").alias("__s"), F.col("bucket").alias("__k"),
        F.coalesce(F.sum("__b").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = rows.withColumn("__in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("__s")) & (F.col("bucket") == F.col("__k"))).select(
        *keys, "doc_id", "source", "size", "__h", (F.col("before") + F.col("__in")).alias("start"))
    rows = rows.join(targets.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")))

    def tickets(count: int) -> str:
        return "array(" + ", ".join(f"named_struct('pass', {e}, 'block', b, 'ticket', {e} * blocks + "
                                    f"{_permuted('b', 'blocks', f'keys{e}')})" for e in range(count)) + ")"

    deals = tickets(most)
    for e in range(most - 1, 0, -1):  # passes beyond the quota have no tickets
        deals = f"if(element_at(ends, -1) <= {e} * blocks, {tickets(e)}, {deals})"
    w = f"{block_words}L"
    pieces = f"""if(size = 0, array(), transform(
        filter(flatten(transform(sequence(start div {w}, (start + size - 1) div {w}), b -> {deals})),
               t -> t.ticket < element_at(ends, -1)),
        t -> named_struct(
            'pass', t.pass, 'block', t.block,
            'shard', size(filter(ends, e -> e <= t.ticket)),
            'place', xxhash64({seed}, t.pass, t.block, __h),
            'first', greatest(0L, t.block * {w} - start),
            'words', least(start + size, (t.block + 1) * {w}) - greatest(start, t.block * {w}))))"""
    return rows.select(*keys, "doc_id", "source", "size", "source_size", "target", F.expr(pieces).alias("pieces"))


def _taken(docs: DataFrame, cuts: Cuts, **options) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` with a key, and the pieces of those that the mix takes."""
    keyed = row_keyed(docs, cuts)
    flat = keyed.select("__file", "__row", *[F.col("__doc")[n].alias(n) for n in ("doc_id", "source", "text")])
    return keyed, cuts.cut(mix(flat, ["__file", "__row"], cuts, **options)
                           .where(F.size("pieces") > 0).select("__file", "__row", "size", "pieces"))


def _words(text: str) -> str:
    """SQL: the words of a text, each with the white space after it."""
    return f"split(regexp_replace({text}, '^[{_SPACE}]+', ''), '(?<=[{_SPACE}])(?=[^{_SPACE}])')"


def mix_shards(docs: DataFrame, shards: int = SHARDS, file_words: int = FILE_WORDS, **options) -> DataFrame:
    """The mix as its shards: ``(shard, place, doc_id, source, pass, block, first,
    words, text)``, a row for each piece.

    A shard is dealt to as many partitions as its words need at ``file_words``
    each, and every partition is in the order of ``place``, the local shuffle.
    ``text`` keeps the white space between the words and after the last.
    An empty table, or one without words, gives an empty result.
    """
    cuts = Cuts(docs.sparkSession)
    keyed, plan = _taken(docs, cuts, shards=shards, **options)
    total = plan.agg(F.sum(F.expr("aggregate(pieces, 0L, (a, p) -> a + p.words)"))).first()[0] or 0
    files = max(1, math.ceil(total / (shards * file_words)))
    # a text is split once, whatever its number of pieces
    cut = f"""element_at(transform(array({_words('__t')}), ws -> transform(pieces, p -> named_struct(
        'p', p, 'text', array_join(slice(ws, cast(p.first as int) + 1, cast(p.words as int)), '')))), 1)"""
    rows = keyed.join(plan, ["__file", "__row"]).select(
        F.col("__doc")["doc_id"].alias("doc_id"), F.col("__doc")["source"].alias("source"),
        F.col("__doc")["text"].alias("__t"), "pieces").select("doc_id", "source", F.explode(F.expr(cut)).alias("c"))
    return rows.select("c.p.shard", "c.p.place", "doc_id", "source", "c.p.pass", "c.p.block", "c.p.first", "c.p.words",
                       "c.text").repartition(shards * files, "shard", F.pmod("place", F.lit(files))) \
        .sortWithinPartitions("shard", "place", "doc_id", "first")


def write_mix(docs: DataFrame, folder: str, **options) -> None:
    """Writes the mix below ``folder``: Parquet in a folder per shard, each file in shuffled order."""
    mix_shards(docs, **options).write.partitionBy("shard").mode("overwrite").parquet(folder)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents, columns unchanged: a row for each pass over a
    document of which the mix takes words, its text the taken words in their
    order (the whole text, unchanged, where all are taken), ``n_chars`` their
    length.  Parts that are not neighbours in the document follow each other
    without a mark.  Rows without words are in no mix."""
    cuts = Cuts(docs.sparkSession)
    keyed, plan = _taken(docs, cuts, **options)
    runs = F.expr("""filter(transform(sequence(0, array_max(transform(pieces, p -> p.pass))), e -> filter(pieces, p -> p.pass = e)),
                            r -> size(r) > 0)""")
    taken = keyed.join(plan, ["__file", "__row"]).select(
        "__doc", "size", F.col("__doc")["text"].alias("__t"), F.explode(runs).alias("run"))
    part = f"""if(aggregate(run, 0L, (a, p) -> a + p.words) = size, __t,
        element_at(transform(array({_words('__t')}), ws -> array_join(transform(array_sort(run, (x, y) ->
            case when x.first < y.first then -1 when x.first > y.first then 1 else 0 end),
            p -> array_join(slice(ws, cast(p.first as int) + 1, cast(p.words as int)), '')), '')), 1))"""
    taken = taken.withColumn("__part", F.expr(part))
    new = {"text": F.col("__part"), "n_chars": F.length("__part").cast("long")}
    return taken.select(*[new.get(n, F.col("__doc")[n]).alias(n) for n in docs.columns])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of the mix, with the shards that take words of a document and
    the words that each of them takes."""
    mixed = mix(table(spark, sf_dir, "documents"), [], Cuts(spark))
    shards = "array_sort(array_distinct(transform(pieces, p -> cast(p.shard as bigint))))"
    return mixed.select(
        "doc_id", "size", "source_size", "target",
        F.expr("aggregate(pieces, 0L, (a, p) -> a + p.words)").alias("taken"),
        F.expr(shards).alias("shards"),
        F.expr(f"transform({shards}, s -> aggregate(filter(pieces, p -> p.shard = s), 0L, (a, p) -> a + p.words))")
        .alias("shard_words"))
