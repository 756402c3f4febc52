"""A corpus pipeline: from raw documents to packed token windows.

``STAGES`` lists ``(name, function)``; each function takes ``(spark, docs,
sf_dir)`` and works on all rows that the stage before it kept.  All but the last
return the columns of their input.  ``run`` writes each stage's rows as Parquet
in the shared folder and rereads them, so a lost executor costs one stage at
most.

What the stages do with odd rows is stated at the operators; in short: null
texts count as empty and empty texts are scored, compared and packed like any
other; a null id never matches another id; repeated rows are copies; columns
that the stages do not know pass through unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from embedscope.llm.blocknames import drop_exact_copies
from embedscope.llm.minhash import drop_near_copies
from embedscope.llm.mixing import mixed_documents
from embedscope.llm.packing import pack
from embedscope.llm.quality import keep_good
from embedscope.llm.work import Cuts, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 0.8 of their five-word shingles."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes from each source, pass by pass."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed windows of 4096 tokens."""
    import public_tokenizers
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``."""
    cuts = Cuts(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        done = cuts.cut(stage(spark, docs, sf_dir))
        cuts.drop(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
