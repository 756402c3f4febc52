"""Chat formatting by quotation linking.

A line that starts with ``>`` marks is quoted, as deep as it has marks.  Each run
of lines of one depth between blank lines is a passage; passages and their single
lines are normalised (lower case, letters and digits only, one space between
words) and hashed.  A message's own passages (depth 0) are joined with the
passages that others quote, at any depth: the original of a quotation is the
latest earlier message of the same conversation with that passage, else the first
message anywhere that has it, if it comes before.  Of the quoted passages with an
original, those at the shallowest depth vote: the message that accounts for the
most characters quoted there is the one replied to, so deeper levels count where
nothing shallower is known.  A message without a known quotation answers the one
before it in its conversation.

Replies form trees; pointer doubling finds each message's root and depth in a
logarithmic number of rounds, however long a conversation is.  The result has a
row a message, its text without quotations, in reply order (``position`` within
``thread``): every message stands after the one that it answers.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from embedscope.llm.blocknames import dense_names
from embedscope.llm.work import Cuts, table

_MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)")
_LEADS = re.compile(r"^[^\n]{0,200}\b(?:wrote|writes|schrieb|écrit|escribió)\s*:\s*$", re.IGNORECASE)
_WORDS = re.compile(r"[^\W_]+")


def normalised(passage: str) -> str:
    return " ".join(_WORDS.findall(passage.lower()))


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """A message without its quotations, and its passages as ``(depth, text)``.

    A line like ``... wrote:`` right before a quotation goes with it.
    """
    lines: list[tuple[int, str]] = []
    for line in (text or "").split("\n"):
        m = _MARKS.match(line)
        lines.append((m.group(1).count(">"), line[m.end():]) if m else (0, line))
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    last = None
    for i, (depth, body) in enumerate(lines):
        if not depth and i + 1 < len(lines) and lines[i + 1][0] and _LEADS.match(body):
            last = None
            continue
        if not depth:
            own.append(body)
        if not body.strip():
            last = None
        elif last == depth:
            passages[-1][1].append(body)
        else:
            passages.append((depth, [body]))
            last = depth
    kept = "\n".join(own)
    if any(d for d, _ in lines):
        kept = re.sub(r"\n{3,}", "\n\n", kept).strip("\n")
    return kept, [(d, "\n".join(ls)) for d, ls in passages]


def parsed(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, body, passages)``; ``passages`` hold depth, hash,
    and the characters that the hash stands for (a passage or one line of it)."""
    frame = messages.select("conv_id", "turn", "role", "text")
    passage = "array<struct<depth: int, hash: binary, chars: int>>"
    schema = frame.drop("text").withColumn("body", F.lit("")).withColumn(
        "passages", F.lit(None).cast(passage)).schema
    item = pa.list_(pa.struct([("depth", pa.int32()), ("hash", pa.binary()), ("chars", pa.int32())]))

    def run(batches):
        for b in batches:
            bodies, found = [], []
            for t in b.column("text").to_pylist():
                body, passages = parse(t)
                bodies.append(body)
                units = {}
                for depth, p in passages:
                    for unit in {p, *p.split("\n")}:
                        n = normalised(unit)
                        if n:
                            units[depth, xxh3_128_digest(n)] = len(n)
                found.append([{"depth": d, "hash": h, "chars": c} for (d, h), c in units.items()])
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), b.column("turn"), b.column("role"), pa.array(bodies, pa.string()),
                 pa.array(found, item)], ["conv_id", "turn", "role", "body", "passages"])

    return frame.mapInArrow(run, schema)


def _quoted(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, reply, quote_depth)``: the message that each quoting one
    answers, and the depth of the quotation that tells it."""
    units = rows.select("conv_id", "turn", F.explode("passages").alias("p")).select(
        "conv_id", "turn", "p.depth", "p.hash", "p.chars")
    quotes = units.where("depth >= 1").distinct()
    wanted = quotes.select("hash").distinct()
    own = units.where("depth = 0").select("conv_id", "turn", "hash").distinct().join(wanted, "hash", "left_semi")
    first = own.groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("anywhere"))
    # only passages that someone quotes come here: the latest own turn before the quotation
    none = F.lit(None).cast("int")
    both = own.select("conv_id", "hash", "turn", none.alias("depth"), none.alias("chars")).unionByName(
        quotes.select("conv_id", "hash", "turn", "depth", "chars"))
    before = Window.partitionBy("conv_id", "hash").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.max(F.when(F.col("chars").isNull(), F.col("turn"))).over(before)).where(
        "chars is not null")
    me = F.struct("conv_id", "turn")
    found = near.join(first, "hash", "left").select("conv_id", "turn", "depth", "chars", F.when(
        F.col("near").isNotNull(), F.struct("conv_id", F.col("near").alias("turn")))
        .when(F.col("anywhere") < me, F.col("anywhere")).alias("reply")).where("reply is not null")
    votes = found.groupBy("conv_id", "turn", "depth", "reply").agg(F.sum("chars").alias("chars"))
    return votes.groupBy("conv_id", "turn").agg(F.max(F.struct(
        (-F.col("depth")).alias("shallow"), F.col("chars"), (F.col("reply.conv_id") == F.col("conv_id")).alias("same"), F.col("reply"))).alias("best")) \
        .select("conv_id", "turn", "best.reply", (-F.col("best.shallow")).alias("quote_depth"))


def reply_order(messages: DataFrame, cuts: Cuts) -> DataFrame:
    """``(conv_id, turn, role, text, n_quotes, reply_conv, reply_turn, quote_depth,
    thread_conv, thread_turn, depth, position, chat)`` per row of ``messages``.

    ``n_quotes`` counts the quoted passages and lines of all depths;
    ``quote_depth`` is the depth of the quotation that the reply rests on, null
    where it rests on the order of the turns or there is none.
    Null and empty texts have no passages and an empty text; rows that repeat a
    conversation and turn are one message in the links and stay separate rows;
    a row without conversation or turn is linked with nothing (null thread,
    depth and position 0).  An empty table gives an empty result; other columns
    are not read.
    """
    rows = cuts.cut(parsed(messages.select(F.col("conv_id").cast("long").alias("conv_id"),
                                           F.col("turn").cast("long").alias("turn"), "role", "text")))
    known = rows.where("conv_id is not null and turn is not null")
    names = cuts.cut(dense_names(known.select("conv_id", "turn"), cuts))
    quoted = _quoted(known).select("conv_id", "turn", "reply.conv_id", "reply.turn", "quote_depth").toDF(
        "conv_id", "turn", "rc", "rt", "quote_depth")
    target = names.select(F.col("conv_id").alias("rc"), F.col("turn").alias("rt"), F.col("name").alias("quoted"))
    quoted = quoted.join(target, ["rc", "rt"]).select("conv_id", "turn", "quoted", "quote_depth")
    earlier = names.select((F.col("name") + 1).alias("name"), F.col("conv_id").alias("c0"))
    up = names.join(earlier, "name", "left").join(quoted, ["conv_id", "turn"], "left").select(
        "name", F.coalesce("quoted", F.when(F.col("c0") == F.col("conv_id"), F.col("name") - 1)).alias("parent"),
        "quote_depth")
    # pointer doubling: root and depth of each message
    up = cuts.cut(up)
    jump = cuts.cut(up.select("name", F.coalesce("parent", "name").alias("root"),
                              F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth")))
    while True:
        further = jump.select(F.col("name").alias("root"), F.col("root").alias("r2"), F.col("depth").alias("d2"))
        new = cuts.cut(jump.join(further, "root").select(
            "name", F.col("r2").alias("root"), (F.col("depth") + F.col("d2")).alias("depth"),
            (F.col("root") != F.col("r2")).alias("moved")))
        cuts.drop(jump)
        path = new._cut_path
        jump = new.drop("moved")
        jump._cut_path = path
        if new.where("moved").isEmpty():
            break
    order = _positions(jump, cuts)
    at = names.select(F.col("name").alias("n1"), "conv_id", "turn")
    linked = (jump.join(up, "name").join(order, "name")
              .join(at, F.col("name") == F.col("n1")).drop("n1")
              .join(names.toDF("thread_conv", "thread_turn", "root"), "root")
              .join(names.toDF("reply_conv", "reply_turn", "parent"), "parent", "left")
              .select(F.col("conv_id").alias("__c"), F.col("turn").alias("__t"), "reply_conv", "reply_turn", "quote_depth",
                      "thread_conv", "thread_turn", "depth", "position"))
    return rows.join(linked, (F.col("conv_id") == F.col("__c")) & (F.col("turn") == F.col("__t")), "left").select(
        "conv_id", "turn", "role", F.col("body").alias("text"),
        F.size(F.filter("passages", lambda p: p.depth >= 1)).alias("n_quotes"),
        "reply_conv", "reply_turn", "quote_depth", "thread_conv", "thread_turn",
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.coalesce("position", F.lit(0)).cast("long").alias("position"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("body"), F.lit("\n<|end|>\n")).alias("chat"))


def _positions(jump: DataFrame, cuts: Cuts) -> DataFrame:
    """``(name, position)``: the place of each message in its thread, by one
    global order of (root, message) and the first place of each root."""
    placed = cuts.cut(dense_names(jump.select("root", F.col("name").alias("message")), cuts))
    first = placed.groupBy("root").agg(F.min("name").alias("first"))
    return placed.join(first, "root").select(F.col("message").alias("name"),
                                             (F.col("name") - F.col("first")).alias("position"))


def op8_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_order(table(spark, sf_dir, "conversations"), Cuts(spark))
