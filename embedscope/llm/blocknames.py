"""Exact deduplication by deterministic block naming.

A text is cut into blocks of ``block_bytes`` bytes.  The distinct blocks are
sorted and numbered: equal blocks get equal integers, different blocks different
ones.  Then adjacent pairs of names are sorted and numbered in the same way,
level after level, until each text has one name; an odd last name is paired with
-1.  Texts with equal (level, name) are equal, with no chance of a collision.

Sorting moves fingerprints, not texts: the sort key of a block is ``(fingerprint,
number of the content among the contents with that fingerprint)``.  Whole block
contents are grouped once, with partial aggregation, to find fingerprints with
several contents; only those blocks are joined on their content.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from embedscope.llm.work import Cuts, row_keyed, table

BLOCK_BYTES = 4096


def dense_names(keys: DataFrame, cuts: Cuts) -> DataFrame:
    """The distinct rows of ``keys`` with ``name``: 0, 1, 2, ... in their order.

    One range exchange and one sort; the sorted rows are written with their
    partition and position, and the partitions' offsets (one row a partition)
    come from the written table.
    """
    cols = keys.columns
    spark = keys.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cuts.cut(keys.distinct().repartitionByRange(parts, *cols).sortWithinPartitions(*cols)
                      .withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    # one row for each of `parts` partitions: the bound of this window and this broadcast
    offsets = sizes.select("__p", (F.sum("__n").over(
        Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))).alias("__before"))
    return (placed.withColumn("__p", part).join(F.broadcast(offsets), "__p")
            .select(*cols, (F.coalesce("__before", F.lit(0)) + F.col("__at") % F.lit(1 << 33)).alias("name")))


def _blocks(text: str, size: int) -> Column:
    """Array of a text's blocks; the empty text has one empty block."""
    return F.expr(f"""transform(
        sequence(0, greatest(0, cast(ceil(octet_length({text}) / {size}D) as int) - 1)),
        i -> substring(cast({text} as binary), i * {size} + 1, {size}))""")


def exact_groups(docs: DataFrame, keys: list[str], cuts: Cuts, block_bytes: int = BLOCK_BYTES,
                 fingerprint: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``(*keys, doc_id, keep_id, group_size, kept, text_sha256)``, one row per row.

    A null text counts as empty.  In a group of equal texts the row with the
    largest doc_id stays (null is smaller than any id; of rows that repeat the
    id, one stays).  ``fingerprint`` only decides how much is joined on content.
    An empty table gives an empty result; other columns are not read.
    """
    texts = docs.select(*keys, "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    blocks = _blocks("__text", block_bytes)

    # fingerprints that stand for more than one content: normally none
    contents = (texts.select(F.explode(blocks).alias("content"))
                .select(fingerprint(F.col("content")).alias("h"), "content").distinct())
    several = contents.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    clashes = cuts.cut(contents.join(several, "h").select(
        "h", "content", F.row_number().over(Window.partitionBy("h").orderBy("content")).alias("sub")))

    tag = fingerprint(F.col("b"))
    rows = texts.select(
        F.monotonically_increasing_id().alias("__id"), *keys, "doc_id",
        F.sha2(F.col("__text"), 256).alias("text_sha256"), blocks.alias("__blocks"))
    if clashes.isEmpty():
        rows = cuts.cut(rows.select("__id", *keys, "doc_id", "text_sha256",
                                    F.transform("__blocks", lambda b: fingerprint(b)).alias("hs")))
        level = rows.select("__id", F.posexplode("hs").alias("pos", "h")).withColumn("sub", F.lit(0))
    else:
        rows = cuts.cut(rows)
        level = (rows.select("__id", F.posexplode("__blocks").alias("pos", "b"))
                 .select("__id", "pos", tag.alias("h"), F.col("b").alias("content"))
                 .join(clashes, ["h", "content"], "left")
                 .select("__id", "pos", "h", F.coalesce("sub", F.lit(0)).alias("sub")))

    names = dense_names(level.select("h", "sub"), cuts)
    level = cuts.cut(level.join(names, ["h", "sub"]).select("__id", "pos", "name")
                     .join(rows.select("__id", F.size(F.col("hs" if "hs" in rows.columns else "__blocks"))
                                       .alias("n")), "__id"))
    done, k = [], 0
    while True:
        done.append(level.where("n = 1").select("__id", F.lit(k).alias("level"), "name"))
        rest = level.where("n > 1")
        if rest.isEmpty():
            break
        pairs = rest.groupBy("__id", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1).cast("long")).alias("b"),
            F.ceil(F.max("n") / 2).cast("int").alias("n"))
        names = dense_names(pairs.select("a", "b"), cuts)
        level = cuts.cut(pairs.join(names, ["a", "b"]).select("__id", "pos", "name", "n"))
        k += 1

    identity = done[0]
    for d in done[1:]:
        identity = identity.unionByName(d)
    ided = rows.select("__id", *keys, "doc_id", "text_sha256").join(identity, "__id")
    groups = ided.groupBy("level", "name").agg(
        F.max(F.struct("doc_id", "__id")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    return ided.join(groups, ["level", "name"]).select(
        *keys, "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
        (F.col("keep.__id") == F.col("__id")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, columns unchanged."""
    cuts = Cuts(docs.sparkSession)
    keyed = row_keyed(docs, cuts)
    flat = keyed.select("__file", "__row", F.col("__doc.doc_id").alias("doc_id"), F.col("__doc.text").alias("text"))
    kept = exact_groups(flat, ["__file", "__row"], cuts).where("kept").select("__file", "__row")
    return (keyed.join(kept, ["__file", "__row"], "left_semi")
            .select(*[F.col("__doc")[n].alias(n) for n in docs.columns]))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), [], Cuts(spark))


OP3_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
