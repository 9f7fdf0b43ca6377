"""A corpus pipeline of five stages over ``documents``; each stage's result is written and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabflow.llm import decontam, langid, minhash, mixing, packing
from tabflow.llm.common import materialise, read_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null texts, texts without letters) go."""
    return langid.accepted_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (similarity 0.8 and more) the document with the smallest id stays."""
    return minhash.kept_documents(docs, minhash.LOOSE_PER_HUNDRED, minhash.LOOSE_BANDS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; one item, copied whole or in part, is enough."""
    return decontam.clean_documents(docs, read_table(spark, sf_dir, "benchmark"), least_items=1)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stays as often as the mix takes it, in the schedule's order; the last copy may be cut to the words taken."""
    return mixing.mixed_documents(docs)


def token_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as packed rows of token ids, written as binary files."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_packing", token_packing),
]

#: No SQL: the classifiers' predictions and the tokenizer can't be expressed in it.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; what each returns is written as Parquet and read by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
