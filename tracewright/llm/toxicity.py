"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import ftrl
from .common import WordHash, crc_remainder, keep_rows, map_rows, read

WORD = re.compile(r"\w+")
SPANS = ((0,), (0, 1), (0, 2))
#: Labelled documents to learn from, at most.
SAMPLE = 16_000
THRESHOLD = 0.7


def features():
    """Maker of a function from a text to the slots of its words, bigrams and skip-grams."""
    hashes = WordHash()

    def make(text: str | None) -> np.ndarray:
        words = WORD.findall(text.lower()) if text else []
        return ftrl.slots(np.array([hashes[w] for w in words], np.uint64), SPANS)

    return make


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> dict:
    return ftrl.train(docs, labels, "toxic", 3, 1, features, bound, epochs=6, alpha=2.0, l1=3.0, l2=0.0)


def score(docs: DataFrame, labels: DataFrame | None = None, model: dict | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row.

    Null and empty texts get the intercept's score. held_out is null for a null doc_id.
    Repeated rows are scored each; other columns are ignored.
    """
    model = train(docs, labels) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        of = ftrl.scorer(shared.value, features)

        def one(doc_id, held, text):
            s = of(text)
            return doc_id, held, s, int(s >= THRESHOLD)

        return one

    return map_rows(docs.select("doc_id", (crc_remainder("doc_id", 3) == 1).alias("held_out"), "text"), ["doc_id", "held_out", "text"], work, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame | None = None, model: dict | None = None) -> DataFrame:
    """The rows with a score under ``THRESHOLD``; all columns stay."""
    model = train(docs, labels) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        of = ftrl.scorer(shared.value, features)
        return lambda text: of(text) < THRESHOLD

    return keep_rows(docs, ["text"], work)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
