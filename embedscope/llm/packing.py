"""Packing token sequences into windows by best-fit decreasing.

Each document's ids (with the end id) are cut: full windows first, then the
rest.  The rests are dealt at random to groups of about ``group_windows``
windows' worth of ids; each group is packed on its own, longest first, each
piece into the open window with the least room that still holds it.  The open
windows are found with a segment tree indexed by remaining capacity.  Only
pieces' numbers are shuffled, never ids.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embedscope.llm.encode import encoder, forget
from embedscope.llm.work import Cuts, release_memory, slices, table

WINDOW = 4096
END_ID = 2
GROUP_WINDOWS = 2048


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Window number and offset of each piece; ``lengths`` are given longest
    first and none exceeds ``window``.

    ``tree`` counts the open windows by remaining capacity; a query walks up
    from the leaf of the length and down again to the least capacity at or above.
    """
    leaves = 1 << window.bit_length()
    tree = [0] * (2 * leaves)
    open_windows: list[list[int]] = [[] for _ in range(window + 1)]
    number, offset, made = [], [], 0
    for length in lengths:
        node = leaves + length
        if not tree[node]:
            while node > 1 and not (node & 1 == 0 and tree[node + 1]):
                node >>= 1
            if node > 1:
                node += 1
                while node < leaves:
                    node = 2 * node if tree[2 * node] else 2 * node + 1
        if node > 1:
            room = node - leaves
            w = open_windows[room].pop()
            while node:
                tree[node] -= 1
                node >>= 1
        else:
            room, w, made = window, made, made + 1
        number.append(w)
        offset.append(window - room)
        room -= length
        if room:
            open_windows[room].append(w)
            node = leaves + room
            while node:
                tree[node] += 1
                node >>= 1
    return number, offset


def cut_documents(docs: DataFrame, tokenizer: str, keeps_space: bool, end_id: int, window: int,
                  with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens[, ids])``, a row a piece."""
    frame = docs.select("doc_id", "text")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    schema = frame.drop("text").schema
    for n in names[1:5]:
        schema = schema.add(n, "long")
    if with_ids:
        schema = schema.add("ids", "binary")

    def run(batches):
        enc = encoder(tokenizer, keeps_space)
        end = np.array([end_id], "<u4")
        b = out = cols = None
        for b in slices(batches, "text"):
            out, index = [], []
            for i, packed in enumerate(enc.packed(b.column("text").to_pylist())):
                ids = np.concatenate([np.frombuffer(packed, enc.dtype).astype("<u4"), end])
                for s in range(0, len(ids), window):
                    data = ids[s:s + window].tobytes()
                    index.append(i)
                    out.append((s, len(data) // 4, zlib.crc32(data), len(ids), data if with_ids else None))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(index))] + [pa.array(c, pa.int64()) for c in cols[:4]]
                    + [pa.array(cols[4], pa.binary())] * with_ids, names)
        del b, out, cols
        release_memory()

    return frame.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, keeps_space: bool = False, end_id: int = END_ID,
         window: int = WINDOW, group_windows: int = GROUP_WINDOWS, with_ids: bool = False) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset`` (gapless from 0 in a sequence).

    A null or empty text is the end id alone; repeated rows are separate
    documents; a null id stays null; an empty table gives an empty result; other
    columns are not read.  ``with_ids`` adds the ids (unsigned 32-bit).
    """
    cuts = Cuts(docs.sparkSession)
    pieces = cuts.cut(cut_documents(docs, tokenizer, keeps_space, end_id, window, with_ids)
                      .withColumn("__id", F.monotonically_increasing_id()))
    payload = [c for c in pieces.columns if c != "__id"]
    rest = pieces.where(F.col("length") < window)
    ids = rest.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-ids // (window * group_windows)))

    def run(t: pa.Table) -> pa.Table:
        forget()
        t = t.sort_by([("length", "descending"), ("__id", "ascending")])
        number, offset = best_fit_decreasing(t["length"].to_pylist(), window)
        base = t["__g"][0].as_py() << 32
        return t.select(["__id"]).append_column("sequence_id", pa.array([base + n for n in number], pa.int64())) \
            .append_column("offset", pa.array(offset, pa.int64()))

    # a group holds group_windows windows' worth of ids, whatever the input
    placed = (rest.select("__id", "length", F.pmod(F.xxhash64("__id"), F.lit(groups)).alias("__g"))
              .repartition(groups, "__g").groupBy("__g")
              .applyInArrow(run, "__id long, sequence_id long, offset long"))
    whole = pieces.where(F.col("length") == window).select(
        *payload, (F.lit(groups << 32) + F.col("__id")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return rest.join(placed, "__id").select(*payload, "sequence_id", "offset").unionByName(whole)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
