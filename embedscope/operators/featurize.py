"""Text to vectors (E1-E3, re-aimed).

The reference runs transformer models row by row; here the data part of
that step is kept: tokens of the *whole* text, token vectors, masked mean
pooling per text, several "models" over the same text.  The built-in token
vectors are one-hot hashed buckets (md5, so an SQL engine can reproduce
them); mean pooling of one-hot vectors is a count per (text, bucket)
divided by the token count, i.e. a group-by, not a dense explode.  MLlib
featurisers (HashingTF + IDF, Word2Vec) are offered as further models, and
a user's own model plugs in with ``predict_batch_udf``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the built-in hashing models.
TOKEN_PATTERN = r"\s+"
DEFAULT_DIM = 64
#: Bytes of the texts (and their number) that a task splits at a time, and tokens whose bucket it remembers.
TEXT_BYTES, TEXTS_AT_ONCE = 4 << 20, 4096
KNOWN_TOKENS = 200_000
TEXT_MODELS = (("words", "unigram", ""), ("bigrams", "bigram", ""), ("words_salted", "unigram", "s2:"))


def token_array(text) -> Column:
    """Whitespace tokens of the whole text, empty tokens dropped."""
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(t, TOKEN_PATTERN), lambda x: x != F.lit(""))


def bigram_array(toks: Column) -> Column:
    """Adjacent token pairs.  ``zip_with`` against the array shifted by one
    evaluates the token array once per row (an index lambda would re-split
    the text for every element)."""
    pairs = F.zip_with(toks, F.slice(toks, 2, F.greatest(F.size(toks), F.lit(1))),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(pairs, lambda x: x.isNotNull())


def bucket(token: Column, dim: int, salt: str = "") -> Column:
    """md5 bucket of a token in [0, dim)."""
    h = F.md5(F.concat(F.lit(salt), token))
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int")


def mean_pool(tokens: DataFrame, id_col: str = "id", vec_col: str = "vec",
              mask_col: str = "mask") -> DataFrame:
    """Masked mean pooling of the dense token vectors of whole texts, ``(id, mask,
    vec)`` -> ``(id, embedding)``; texts without an unmasked token have no row."""
    return (tokens.where(F.col(mask_col) == 1).select(id_col, array_to_vector(vec_col).alias("__f"))
            .groupBy(id_col).agg(Summarizer.mean(F.col("__f")).alias("__m"))
            .select(id_col, vector_to_array("__m").alias("embedding")))


def hashed_embedding(texts: DataFrame, id_col: str = "id", text_col: str = "text", dim: int = DEFAULT_DIM,
                     analyzer: str = "unigram", salt: str = "") -> DataFrame:
    """Mean of one-hot hashed token vectors over the whole text.

    Sparse result ``(id, bucket, weight, n_tokens)`` (weight = share of the
    text's tokens in the bucket).  Texts without tokens have no rows.
    """
    toks = token_array(text_col)
    if analyzer == "bigram":
        toks = bigram_array(toks)
    elif analyzer != "unigram":
        raise ValueError(f"unknown analyzer {analyzer}")
    ex = texts.select(F.col(id_col).alias("id"), F.explode(toks).alias("token"))
    counts = ex.groupBy("id", bucket(F.col("token"), dim, salt).alias("bucket")).agg(
        F.count(F.lit(1)).alias("c"))
    total = counts.groupBy("id").agg(F.sum("c").alias("n_tokens"))
    return counts.join(total, "id").select("id", "bucket", (F.col("c") / F.col("n_tokens")).alias("weight"),
                                           "n_tokens")


def densify(sparse: DataFrame, ids: DataFrame, dim: int = DEFAULT_DIM, id_col: str = "id") -> DataFrame:
    """Sparse ``(id, bucket, weight)`` -> dense ``(id, embedding)`` for every
    id of ``ids`` (zero vector when a text has no tokens).  Per id at most
    ``dim`` entries are gathered."""
    m = sparse.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("__m"))
    full = ids.select(F.col(id_col).alias("id")).join(m, "id", "left")
    vec = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                      lambda i: F.coalesce(F.try_element_at(F.col("__m"), i), F.lit(0.0)))
    return full.select(F.col("id").alias(id_col), F.when(F.col("__m").isNull(),
                                                         F.array_repeat(F.lit(0.0), dim)).otherwise(vec)
                       .alias("embedding"))


def text_embeddings(texts: DataFrame, id_col: str = "id", text_col: str = "text", dim: int = DEFAULT_DIM,
                    analyzer: str = "unigram", salt: str = "") -> DataFrame:
    """E2 dense: ``(id, embedding)``."""
    sp = hashed_embedding(texts, id_col, text_col, dim, analyzer, salt)
    return densify(sp, texts.select(id_col), dim, id_col)


def _text_slices(batch: pa.RecordBatch):
    """Runs of a batch's rows of at most TEXT_BYTES of text (or one row)."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(size, (size[start - 1] if start else 0) + TEXT_BYTES, side="right"))
        end = max(start + 1, min(end, start + TEXTS_AT_ONCE))
        yield batch.slice(start, end - start)
        start = end


def document_vectors(texts: DataFrame, id_col: str = "id", text_col: str = "text", dim: int = DEFAULT_DIM,
                     parts: int | None = None) -> DataFrame:
    """E2 dense in one pass without a shuffle: ``(id, embedding)`` as
    :func:`text_embeddings` gives it (unigrams, no salt), a row for each row.

    With ``parts``: ``(id, response_id, embedding)``, the vectors of the text's
    tokens dealt in turn to ``parts`` partial texts, those without tokens left out.
    """
    frame = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = frame.select("id").schema
    if parts:
        out = out.add("response_id", "long")
    out = out.add("embedding", T.ArrayType(T.DoubleType()))

    def buckets(tokens: pa.Array, known: dict) -> np.ndarray:
        at = np.empty(len(tokens), np.int64)
        _, offsets, data = tokens.cast(pa.binary()).buffers()
        ends = np.frombuffer(offsets, np.int32, len(tokens) + 1, 4 * tokens.offset).tolist() if len(tokens) else [0]
        data = data.to_pybytes() if data else b""
        for i in range(len(tokens)):
            token = data[ends[i]:ends[i + 1]]
            k = known.get(token)
            if k is None:
                k = int.from_bytes(hashlib.md5(token).digest()[:4]) % dim
                if len(known) < KNOWN_TOKENS:
                    known[token] = k
            at[i] = k
        return at

    def run(batches):
        known: dict = {}
        for b in batches:
            for some_rows in _text_slices(b):
                n = some_rows.num_rows
                words = pc.ascii_split_whitespace(pc.fill_null(some_rows.column("text"), ""))
                row, word = np.repeat(np.arange(n), pc.list_value_length(words).to_numpy(zero_copy_only=False)), words.flatten()
                full = pc.greater(pc.binary_length(word), 0)
                row, word = row[full.to_numpy(zero_copy_only=False)], word.filter(full)
                coded = word.dictionary_encode()  # each distinct token is looked up once
                at = buckets(coded.dictionary, known)[coded.indices.to_numpy(zero_copy_only=False)]
                unit, units = row, n
                if parts:  # dealt in turn
                    n_tokens = np.bincount(row, minlength=n)
                    place = np.arange(len(row)) - (np.cumsum(n_tokens) - n_tokens)[row]
                    unit, units = row * parts + place % parts, n * parts
                total = np.bincount(unit, minlength=units)
                vectors = np.bincount(unit * dim + at, minlength=units * dim).reshape(units, dim) / np.maximum(1, total)[:, None]
                some = np.flatnonzero(total) if parts else np.arange(n)
                flat = pa.array(vectors[some].reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * dim, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays(
                    [some_rows.column("id").take(pa.array(some // (parts or 1), pa.int64())),
                     *([pa.array(some % parts, pa.int64())] if parts else []), lists], out.names)

    return frame.mapInArrow(run, out)


def text_models(texts: DataFrame, id_col: str = "id", text_col: str = "text", dim: int = DEFAULT_DIM,
                models=TEXT_MODELS) -> DataFrame:
    """Several models on the same texts, long ``(model, model_pos, id,
    embedding)``, one dimension for all."""
    out = None
    for pos, (name, analyzer, salt) in enumerate(models):
        part = text_embeddings(texts, id_col, text_col, dim, analyzer, salt).select(
            F.lit(name).alias("model"), F.lit(pos).alias("model_pos"), id_col, "embedding")
        out = part if out is None else out.unionByName(part)
    return out


def mllib_embeddings(texts: DataFrame, id_col: str = "id", text_col: str = "text", kind: str = "tfidf",
                     dim: int = DEFAULT_DIM, seed: int = 42) -> DataFrame:
    """E2 with MLlib featurisers: ``tfidf`` (HashingTF + IDF) or
    ``word2vec`` (mean of word vectors).  ``(id, embedding)``."""
    from pyspark.ml.feature import IDF, HashingTF, Word2Vec
    toks = texts.select(F.col(id_col).alias("id"), token_array(text_col).alias("tokens"))
    if kind == "tfidf":
        tf = HashingTF(inputCol="tokens", outputCol="tf", numFeatures=dim).transform(toks)
        model = IDF(inputCol="tf", outputCol="v").fit(tf)
        out = model.transform(tf)
    elif kind == "word2vec":
        w2v = Word2Vec(inputCol="tokens", outputCol="v", vectorSize=dim, seed=seed, minCount=1)
        out = w2v.fit(toks).transform(toks)
    else:
        raise ValueError(f"unknown featuriser {kind}")
    return out.select(F.col("id").alias(id_col), vector_to_array("v").alias("embedding"))
