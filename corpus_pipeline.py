"""From raw documents to packed training sequences in five stages.

Each stage is a function of ``(spark, docs, sf_dir)``; what it returns is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontam, packing, pii, simhash, toxicity
from quillon.llm.common import materialize


def _with_n_chars(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows a changed text."""
    if not {"n_chars", "text"} <= set(docs.columns):
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(kind)))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go: those that score 0.5 or more. Null and empty texts stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.train(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles of Jaccard similarity 0.8 or more, and what
    such links connect) the document of smallest id stays, once; one without an id stays only in a
    group that has no other."""
    return simhash.drop_near_copies(docs, similarity=0.8, shingle=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents (windows of two items or more) go; in the others every benchmark
    passage is cut out. Documents without one stay as they are."""
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), clean_below=2)
    return _with_n_chars(found.select(*docs.columns))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind in brackets."""
    return _with_n_chars(pii.redact(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as pieces, with their token ids, placed in sequences of at most 2048 tokens."""
    return packing.pack(docs, capacity=2048, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", decontaminate),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: SQL has neither the models nor the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
