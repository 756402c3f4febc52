"""What a worker process holds: encoders of earlier stages, texts of large batches."""

from __future__ import annotations

import pyarrow as pa
import public_tokenizers

from embedscope.llm import encode, quality
from embedscope.llm.work import slices


def _batch(texts):
    n = len(texts)
    return pa.RecordBatch.from_arrays(
        [pa.array(range(n), pa.int64()), pa.array([1] * n, pa.int32()), pa.array(texts, pa.string())],
        ["doc_id", "y", "text"])


def test_slices_give_every_row_once_in_order():
    texts = ["a" * 30, None, "", "b" * 250, "c" * 90, "é" * 40, "d"]
    for bound in (1, 100, 1000):
        parts = list(slices(iter([_batch(texts), _batch([]), _batch(texts)]), "text", bound))
        assert [t for p in parts for t in p.column("text").to_pylist()] == texts * 2
        for p in parts:
            sizes = [len((t or "").encode()) for t in p.column("text").to_pylist()]
            assert sum(sizes[1:]) < bound or not any(sizes[1:])
    void = pa.RecordBatch.from_arrays([pa.nulls(3)], ["text"])
    assert [p.num_rows for p in slices([void], "text")] == [3]


def test_training_features_drop_encoders_and_come_in_small_runs():
    # the classifier's training ran beside the packing stage's encoder, a whole batch at a time
    encode.encoder(public_tokenizers.path("word_bpe_49k.json"), False)
    assert encode._encoders
    texts = [f"w{i} same words {'again ' * 9000}" for i in range(200)]
    parts = list(quality._featurise(12)(iter([_batch(texts)])))
    assert not encode._encoders
    assert len(parts) > 1
    assert [i for p in parts for i in p.column("doc_id").to_pylist()] == list(range(200))
    cache = quality._Hashes()
    cells = [quality.features(t, cache, 12)[0].tobytes() for t in texts]
    assert [c for p in parts for c in p.column("cells").to_pylist()] == cells
