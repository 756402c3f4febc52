"""Token-id files in patched frame-of-reference blocks.

Layout of a file (all integers little-endian):

* ``PFOR``, u32 ids in a block;
* blocks: u32 minimum, u8 width, u16 ids, u16 exceptions, then the differences
  from the minimum at ``width`` bits each (lowest bits first, padded to a byte),
  the exceptions' places (u16) and their bits above the width (u32);
* index: u64 start of each block, then per document i64 id, u8 id present, u64 start among the
  file's ids;
* footer: u64 start of the index, u64 blocks, u64 documents, u64 ids, u32 crc32
  of all blocks, ``PFOR``.

A block's width is the one among a few percentiles of its differences' bit
lengths that makes the block smallest; what is wider is an exception.

Files are written in ascending order of ``doc_id``: rows are range-partitioned
on id and text hash (so one hot id is split), sorted, encoded and written one
file a partition.  A task names its file uniquely and returns it as a manifest
row, so files of lost or repeated attempts are never read.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from embedscope.llm.encode import encoder
from embedscope.llm.work import Cuts, delete_path, release_memory, shared_dir, table

END_ID = 0
BLOCK_IDS = 1024
FILE_TEXT_BYTES = 16 << 20
PERCENTILES = (50, 75, 90, 95, 99, 100)

_HEAD = struct.Struct("<4sI")
_BLOCK = struct.Struct("<IBHH")
_FOOT = struct.Struct("<QQQQI4s")
_DOC = np.dtype([("id", "<i8"), ("known", "u1"), ("start", "<u8")])


def _bit_lengths(d: np.ndarray) -> np.ndarray:
    """Bits of unsigned 32-bit numbers (0 for 0)."""
    return np.frexp(d.astype(np.float64))[1]


_LENGTHS = _bit_lengths(np.arange(1 << 16)).astype(np.uint8)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Blocks of a ``(blocks, ids in a block)`` array of unsigned 32-bit ids."""
    count, n = ids.shape
    low = ids.min(axis=1)
    diff = ids - low[:, None]
    lengths = _LENGTHS[diff] if diff.max(initial=0) < 1 << 16 else _bit_lengths(diff).astype(np.uint8)
    at_most = np.cumsum(np.bincount(
        (np.arange(count)[:, None] * 33 + lengths).ravel(), minlength=33 * count).reshape(count, 33), axis=1)
    widths = np.stack([(at_most < -(-n * p // 100)).sum(axis=1) for p in PERCENTILES], axis=1)
    over = n - np.take_along_axis(at_most, widths, axis=1)
    sizes = (n * widths + 7) // 8 + 6 * over
    width = widths[np.arange(count), sizes.argmin(axis=1)]
    out: list[bytes] = [b""] * count
    for w in np.unique(width):
        at = np.nonzero(width == w)[0]
        part = diff[at].astype("<u4").view(np.uint8).reshape(len(at), n, 4)[:, :, :(int(w) + 7) // 8]
        if w % 8:
            bits = np.unpackbits(part, axis=2, bitorder="little")[:, :, :w]
            packed = np.packbits(bits.reshape(len(at), -1), axis=1, bitorder="little")
        else:  # whole bytes
            packed = np.ascontiguousarray(part).reshape(len(at), -1)
        for k, b in enumerate(at.tolist()):
            places = np.nonzero(lengths[b] > w)[0]
            out[b] = b"".join((
                _BLOCK.pack(int(low[b]), int(w), n, len(places)), packed[k].tobytes(),
                places.astype("<u2").tobytes(), (diff[b][places].astype(np.uint64) >> np.uint64(w)).astype("<u4").tobytes()))
    return out


def decode_block(data: memoryview, at: int) -> np.ndarray:
    low, width, n, over = _BLOCK.unpack_from(data, at)
    at += _BLOCK.size
    size = (n * width + 7) // 8
    out = np.zeros(n, np.uint64)
    if width == 16 and low < 1 << 31 and not over:
        return np.frombuffer(data, "<u2", n, at) + np.uint32(low)
    if width:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n * width, bitorder="little")
        words = np.zeros((n, 32), np.uint8)
        words[:, :width] = bits.reshape(n, width)
        out = np.packbits(words, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint64)
    at += size
    if over:
        places = np.frombuffer(data, "<u2", over, at)
        high = np.frombuffer(data, "<u4", over, at + 2 * over).astype(np.uint64)
        out[places] |= high << np.uint64(width)
    return (out + np.uint64(low)).astype("<u4")


class FileWriter:
    """Streams ids into one file; holds a few blocks and the index in memory."""

    def __init__(self, sink, block_ids: int = BLOCK_IDS):
        self.sink, self.block_ids = sink, block_ids
        self.at = self.sink.write(_HEAD.pack(b"PFOR", block_ids)) or _HEAD.size
        self.starts, self.docs, self.ids, self.crc = [], [], 0, 0
        self.held: list[np.ndarray] = []
        self.n_held = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is not None, self.ids))
        self.ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= 256 * self.block_ids:
            self._flush(False)

    def _put(self, blocks: list[bytes]) -> None:
        for b in blocks:
            self.starts.append(self.at)
            self.crc = zlib.crc32(b, self.crc)
            self.sink.write(b)
            self.at += len(b)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        n = self.block_ids
        full = len(ids) // n * n
        for s in range(0, full, 256 * n):
            self._put(encode_blocks(ids[s:min(full, s + 256 * n)].reshape(-1, n)))
        rest = ids[full:]
        if last and len(rest):
            self._put(encode_blocks(rest[None, :]))
            rest = rest[:0]
        self.held, self.n_held = [rest], len(rest)

    def close(self) -> None:
        self._flush(True)
        self.sink.write(np.array(self.starts, "<u8").tobytes())
        self.sink.write(np.array(self.docs, _DOC).tobytes())
        self.sink.write(_FOOT.pack(self.at, len(self.starts), len(self.docs), self.ids, self.crc, b"PFOR"))


def read_file(data: bytes):
    """``(doc_id or None, start among the file's ids, ids)`` of each document."""
    view = memoryview(data)
    index, n_blocks, n_docs, n_ids, crc, magic = _FOOT.unpack_from(view, len(view) - _FOOT.size)
    if magic != b"PFOR" or zlib.crc32(view[_HEAD.size:index]) != crc:
        raise ValueError("damaged token file")
    block_ids = _HEAD.unpack_from(view, 0)[1]
    starts = np.frombuffer(view, "<u8", n_blocks, index)
    docs = np.frombuffer(view, _DOC, n_docs, index + 8 * n_blocks)
    ends = np.append(docs["start"][1:], np.uint64(n_ids))
    kept, first = np.empty(0, np.uint32), 0  # decoded blocks that a document may still need
    at = 0
    for d, end in zip(docs, ends.tolist()):
        start = int(d["start"])
        parts, have = [kept[start - first:]], first + len(kept)
        while have < end:
            parts.append(decode_block(view, int(starts[at])))
            have += len(parts[-1])
            at += 1
        kept, first = np.concatenate(parts), start
        yield (int(d["id"]) if d["known"] else None), start, kept[:end - start]


def _filesystem(uri: str):
    scheme, _, rest = uri.partition(":/")
    if scheme == "file":
        uri = "file:///" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, keeps_space: bool = True,
                      end_id: int = END_ID, file_text_bytes: int = FILE_TEXT_BYTES) -> DataFrame:
    """Writes the files below ``folder`` and returns the manifest plan
    ``(part, file, n_docs, n_ids, bytes)``; run it once, through a written table.

    A null text counts as empty and holds the end id alone; null ids come
    first; rows that repeat an id keep an order fixed by their text.
    """
    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = frame.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // file_text_bytes))
    keys = ["doc_id", "__h"]
    placed = (frame.withColumn("__h", F.xxhash64("text")).repartitionByRange(parts, *keys)
              .sortWithinPartitions(*keys).select(F.spark_partition_id().alias("part"), "doc_id", "text"))

    def run(batches):
        enc, writer, sink = encoder(tokenizer, keeps_space), None, None
        end = np.array([end_id], np.uint32)
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                part = b.column("part")[0].as_py()
                name = f"part-{part:06d}-{uuid.uuid4().hex}.pfor"
                fs, base = _filesystem(folder)
                fs.create_dir(base, recursive=True)
                sink = fs.open_output_stream(f"{base}/{name}")
                writer = FileWriter(sink)
            packed = enc.packed(b.column("text").to_pylist())
            for doc_id, p in zip(b.column("doc_id").to_pylist(), packed):
                writer.add(doc_id, np.concatenate([np.frombuffer(p, enc.dtype).astype(np.uint32), end]))
        if writer is not None:
            writer.close()
            size = sink.tell()
            sink.close()
            yield pa.RecordBatch.from_pylist(
                [{"part": part, "file": name, "n_docs": len(writer.docs), "n_ids": writer.ids, "bytes": size}],
                schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()),
                                  ("n_ids", pa.int64()), ("bytes", pa.int64())]))
        release_memory()

    return placed.mapInArrow(run, "part int, file string, n_docs long, n_ids long, bytes long")


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document in the files;
    ``start`` counts the ids of all documents before it."""
    # a row for each file: the bound of this window and of the broadcast
    offsets = manifest.select("file", F.coalesce(F.sum("n_ids").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(folder)
             .select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
             .join(F.broadcast(offsets), "file"))

    def run(batches):
        for b in batches:
            for before, data in zip(b.column("before").to_pylist(), b.column("content")):
                rows = [(i, before + s, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                        for i, s, ids in read_file(data.as_buffer())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("before", "content").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    folder = shared_dir(spark)
    delete_path(spark, folder, at_exit=True)
    docs = table(spark, sf_dir, "documents")
    manifest = Cuts(spark).cut(write_token_files(docs, folder, public_tokenizers.path("byte_bpe_50k.json")))
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_token_files(spark, folder, manifest)
