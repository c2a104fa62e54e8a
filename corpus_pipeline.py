"""A corpus pipeline over documents: language, toxicity, near-duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns those it keeps; the
last one returns the pieces of all documents with their sequences.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.llm import decontaminate, language_id, near_dup, packing, toxicity
from cloudloom.llm.common import table, written
from cloudloom.llm.labels import fold

#: Place of the tokenizer file.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without a letter, or far from every known language, go."""
    model = language_id.fit(docs.filter(fold("doc_id", 4) != 2))
    return language_id.predict(docs, model).filter(~F.col("rejected")).select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0))
    return toxicity.score(docs, model).filter("toxicity < 0.5").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group whose five-word shingles overlap by 0.8 or more."""
    rows = near_dup.near_duplicates(docs, k=5, num=80, den=100)
    gone = rows.filter(F.col("id") != F.col("component")).select(F.col("id").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    rows = packing.pack_documents(docs, TOKENIZER)
    return rows.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("toxicity", toxic),
    ("near_dup", near_duplicates),
    ("decontaminate", benchmark_leaks),
    ("packing", pack),
]

#: SQL cannot say any stage but near_dup; tests/llm holds run() against planted rows, and near_dup and packing against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
