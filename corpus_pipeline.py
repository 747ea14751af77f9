"""Corpus pipeline: language, toxicity, near duplicates, secrets, packing.

Each stage takes ``documents`` as its predecessor left them and returns documents; the
last one returns the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import language, neardup, packing, secrets, toxicity
from tracewright.llm.common import read, reliable_checkpoint


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or whose language stays in doubt."""
    return language.keep_identified(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the model, learnt from the labels of these documents, finds toxic."""
    return toxicity.keep_clean(docs, read(spark, sf_dir, "labels"))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least doc_id of each class of near duplicates."""
    return neardup.keep_first(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences; a row for each piece."""
    return packing.pack(docs)


STAGES = [
    ("language", language_stage),
    ("toxicity", toxicity_stage),
    ("neardup", neardup_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: Trained models and tokenizers have no SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; what a stage returns is checkpointed."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = reliable_checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
