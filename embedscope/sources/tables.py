"""Driver tables and the deterministic inputs derived from them.

Everything here is a lazy DataFrame over the Parquet files; nothing is
materialised.  Derived inputs (see FIXTURES.md):

* ``vectors``   ``(id, embedding array<double>, label)`` from ``embeddings``
* ``planted``   embedding with 2.0 added to element ``label`` (zero-based)
* ``responses`` ``id = vec_id div 5``, ``response_id = vec_id % 5``
* ``models``    raw / reversed / planted as three models on one ``id``
* ``corpus`` / ``queries``: ``label < 5`` / ``label >= 5``
* ``prompts``   ``documents.doc_id`` as id, ``text`` as prompt
* ``doc_vectors``, ``doc_models``, ``doc_responses``: the documents by vectors of
  their own texts, as three models, and five partial texts of each
* ``benchmark_vectors``: the benchmark texts as a corpus
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embedscope.functions import vectors as V
from embedscope.operators.featurize import DEFAULT_DIM, bucket, document_vectors

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Fixed values of the derived inputs.
PLANT_AMOUNT = 2.0
RESPONSES_PER_PROMPT = 5
CORPUS_LABEL_LIMIT = 5
MODEL_NAMES = ("raw", "reversed", "planted")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), V.as_double("embedding").alias("embedding"),
                    F.col("label"))


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return v.select("id", V.add_at("embedding", "label", PLANT_AMOUNT).alias("embedding"), "label")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return v.select(F.floor(F.col("id") / RESPONSES_PER_PROMPT).cast("bigint").alias("id"),
                    (F.col("id") % RESPONSES_PER_PROMPT).cast("bigint").alias("response_id"),
                    "embedding")


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long table ``(model, model_pos, id, embedding)`` from one scan."""
    return _as_models(vectors(spark, sf_dir))


def _as_models(v: DataFrame) -> DataFrame:
    variants = F.array(
        F.struct(F.lit(MODEL_NAMES[0]).alias("model"), F.lit(0).alias("model_pos"),
                 F.col("embedding").alias("embedding")),
        F.struct(F.lit(MODEL_NAMES[1]).alias("model"), F.lit(1).alias("model_pos"),
                 F.reverse("embedding").alias("embedding")),
        F.struct(F.lit(MODEL_NAMES[2]).alias("model"), F.lit(2).alias("model_pos"),
                 V.add_at("embedding", "label", PLANT_AMOUNT).alias("embedding")),
    )
    return (v.select("id", F.explode(variants).alias("m"))
            .select("m.model", "m.model_pos", "id", "m.embedding"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where(F.col("label") < CORPUS_LABEL_LIMIT)


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where(F.col("label") >= CORPUS_LABEL_LIMIT)


def doc_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document by the vector of its own text; its label is a hash of its
    language (noise without one)."""
    d = table(spark, sf_dir, "documents").select(
        F.struct(F.col("doc_id"), F.coalesce(bucket(F.col("lang"), DEFAULT_DIM), F.lit(-1)).alias("label")).alias("id"), "text")
    return document_vectors(d).select(F.col("id.doc_id").alias("id"), "embedding", F.col("id.label").alias("label"))


def doc_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five partial texts of every document, ``(id, response_id, embedding)``."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return document_vectors(d, parts=RESPONSES_PER_PROMPT)


def doc_models(spark: SparkSession, sf_dir: str, vecs: DataFrame | None = None) -> DataFrame:
    """The documents' vectors as three models; ``vecs``: the rows of
    :func:`doc_vectors`, where they are written already."""
    return _as_models(doc_vectors(spark, sf_dir) if vecs is None else vecs)


def benchmark_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark texts as a corpus ``(id, embedding)``."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return document_vectors(b)


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("text").alias("prompt"))
