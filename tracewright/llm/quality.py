"""Quality: hashed word n-gram logistic regression trained with FTRL updates.

Words keep their case, and runs of other characters count as words, so that shouting,
symbol noise and tables show. A few coarse shares of the whole text (upper case words,
symbols, repeated neighbours, distinct words) join the n-grams as words of their own.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import ftrl
from .common import WordHash, crc_remainder, map_rows, read

TOKEN = re.compile(r"\w+|[^\w\s]+")
SPANS = ((0,), (0, 1), (0, 1, 2))
SAMPLE = 12_000
THRESHOLD = 0.7


def features():
    """Maker of a function from a text to the slots of its n-grams and shares."""
    hashes = WordHash()
    shapes = WordHash()

    def make(text: str | None) -> np.ndarray:
        words = TOKEN.findall(text) if text else []
        ids = np.array([hashes[w] for w in words], np.uint64)
        n = len(words)
        upper = sum(map(str.isupper, words))
        alpha = sum(map(str.isalnum, words))
        distinct = len(set(words))
        same = int((ids[1:] == ids[:-1]).sum()) if n > 1 else 0
        log = min(12, n.bit_length())
        shares = [f"{k}:{round(10 * v)}" for k, v in (("upper", upper / max(1, n)), ("symbol", 1 - alpha / max(1, n)), ("same", same / max(1, n)))]
        shares += [f"distinct:{log}:{round(10 * distinct / max(1, n))}", f"size:{log}"]
        extra = np.array([shapes[s] for s in shares], np.uint64)
        return np.concatenate([ftrl.slots(ids, SPANS), (extra * ftrl.MIX[2] >> ftrl.SHIFT).astype(np.uint32)])

    return make


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> dict:
    return ftrl.train(docs, labels, "quality", 4, 2, features, bound, l1=1.0)


def score(docs: DataFrame, labels: DataFrame | None = None, model: dict | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row.

    Null and empty texts are scored by the shares of an empty text. held_out is null for a
    null doc_id. Repeated rows are scored each; other columns are ignored.
    """
    model = train(docs, labels) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        of = ftrl.scorer(shared.value, features)

        def one(doc_id, held, text):
            s = of(text)
            return doc_id, held, s, int(s >= THRESHOLD)

        return one

    return map_rows(docs.select("doc_id", (crc_remainder("doc_id", 4) == 2).alias("held_out"), "text"), ["doc_id", "held_out", "text"], work, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
