"""Documents to training sequences in five stages.

Every stage takes the documents that its predecessor kept; all but the last return the columns of
``documents``.  The result is one row per piece of a document in a training sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from secretsieve.llm import line_dedup, mixing, packing, quality_rules, simhash
from secretsieve.llm.common import documents, landed
from secretsieve.llm.queries import tokenizer_path

ORACLE_SQL = None  # SQL cannot express fingerprints or tokens; tests/llm compares each stage with plain Python


def measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Bring ``n_chars`` up to date with the text."""
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.lit(0).cast("long"))).select(*columns)


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Rejected documents go; lines that a host repeats stay in its first document only."""
    return measured(quality_rules.clean(docs), docs.columns)


def lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Lines of many documents stay in the last one only.  Columns that the operator would replace keep their values."""
    away = {c: f"_in{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    cleaned = line_dedup.dedup_lines(docs.withColumnsRenamed(away)).drop("n_lines", "n_dropped")
    return measured(cleaned.withColumnsRenamed({new: c for c, new in away.items()}), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least id."""
    return simhash.keep_one(docs, shingle_words=3, max_bits=2)


def mixture(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Sources by weight, at most three epochs each; a row per repetition."""
    return measured(mixing.mix(docs, weights=(5, 2, 1), epochs=3), docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, tokenizer_path()).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("mixing", mixture),
    ("packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read back, and goes when the next one is there."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir), name, instead_of=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
