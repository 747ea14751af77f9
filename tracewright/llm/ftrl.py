"""FTRL-proximal logistic regression over hashed binary features.

Each weight has its own learning rate, and an L1 penalty that keeps the weights of rare
features at zero, so a model is a short list of (slot, weight) pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, crc_remainder, giving_back, small_batches

BITS = 20
SHIFT = np.uint64(64 - BITS + 1)
#: Single words take the lower half of the slots and value 1; longer grams the upper half
#: and a smaller value, so that they don't take over what a word explains.
HALF = np.uint32(1 << (BITS - 1))
GRAM_VALUE = 0.3
#: Odd multipliers for the places of an n-gram; wrapping products mix the word hashes.
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def slots(hashes: np.ndarray, spans: tuple[tuple[int, ...], ...]) -> np.ndarray:
    """Slots of the n-grams of a text. hashes: uint64 of its words; spans: the offsets of an
    n-gram's words, as (0,), (0, 1) for bigrams, (0, 2) for skip-grams over one word."""
    out, n = [], len(hashes)
    for k, offsets in enumerate(spans):
        m = n - offsets[-1]
        if m <= 0:
            continue
        mixed = np.full(m, k + 1, np.uint64) * MIX[3]
        for place, offset in enumerate(offsets):
            mixed = (mixed ^ hashes[offset : offset + m]) * MIX[place]
            mixed ^= mixed >> np.uint64(29)
        out.append((mixed * MIX[1] >> SHIFT).astype(np.uint32) + HALF * np.uint32(len(offsets) > 1))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def values(x: np.ndarray) -> np.ndarray:
    return np.where(x < HALF, 1.0, GRAM_VALUE)


def fit(examples: list[tuple[np.ndarray, int]], epochs: int = 4, alpha: float = 0.25, beta: float = 1.0, l1: float = 1.0, l2: float = 0.05) -> tuple[float, np.ndarray, np.ndarray]:
    """(intercept, slots, weights for slots that are present) after ``epochs`` passes over (distinct slots, label) pairs, in order."""
    size = 1 << BITS
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    z0 = n0 = w0 = 0.0
    for _ in range(epochs):
        for x, y in examples:
            v = values(x)
            p = 1.0 / (1.0 + np.exp(-np.clip(w0 + (w[x] * v).sum(), -30, 30)))
            g = p - y
            root = np.sqrt(n[x])
            grown = n[x] + (g * v) ** 2
            after = np.sqrt(grown)
            zx = z[x] + g * v - (after - root) / alpha * w[x]
            z[x], n[x] = zx, grown
            w[x] = np.where(np.abs(zx) <= l1, 0.0, -(zx - np.sign(zx) * l1) / ((beta + after) / alpha + l2))
            after0 = np.sqrt(n0 + g * g)
            z0 += g - (after0 - np.sqrt(n0)) / alpha * w0
            n0 += g * g
            w0 = -z0 / ((beta + after0) / alpha + l2)
    kept = np.flatnonzero(w)
    return float(w0), kept.astype(np.uint32), (w * values(np.arange(size)))[kept].astype(np.float32)


def labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, bound: int) -> DataFrame:
    """At most about ``bound`` (doc_id, text, y) rows to learn from.

    Labels count if crc32(doc_id as text) % modulus isn't ``held``; null labels and ids
    don't, and of contradicting labels for an id the largest does. Of several texts under one
    id the smallest counts. Only the sampled ids (bounded) are broadcast; texts are not
    shuffled to find them.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (crc_remainder("doc_id", modulus) != held)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = bounded_sample(known, "doc_id", bound).select("doc_id", "y")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


def train(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, features: Callable[[], Callable[[str | None], np.ndarray]], bound: int, **how) -> dict:
    """A model learnt from a sample of at most ``bound`` labelled documents.

    Texts become distinct slots where they are; one task, which updates are made in, gets only
    slots. The order of learning is that of a hash of doc_id, so the model doesn't depend on how
    rows are dealt out. Without examples, or with one class only, scores are constant.
    """

    def hashed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        make = features()
        for batch in batches:
            slots_of = [np.unique(make(text)).astype("<u4").tobytes() for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(slots_of, pa.binary()), batch.column(2)], names=["doc_id", "slots", "y"])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        examples = [(np.frombuffer(x, "<u4"), y) for batch in batches for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        w0, at, w = fit(examples, **how)
        yield pa.RecordBatch.from_pydict({"slot": np.append(at.astype("int64"), -1), "w": np.append(w.astype("float64"), w0)})

    sample = small_batches(labelled(docs, labels, label, modulus, held, bound)).select(F.col("doc_id").cast("long"), "text", "y").mapInArrow(giving_back(hashed), "doc_id long, slots binary, y int")
    ordered = sample.repartition(1).sortWithinPartitions(F.xxhash64(F.lit(5), F.col("doc_id")))
    rows = ordered.select("slots", "y").mapInArrow(giving_back(run), "slot long, w double").collect()
    at = [(r["slot"], r["w"]) for r in rows if r["slot"] >= 0]
    return {"intercept": sum(r["w"] for r in rows if r["slot"] < 0), "slots": np.array([s for s, _ in at], np.uint32), "weights": np.array([w for _, w in at], np.float32)}


def scorer(model: dict, features: Callable[[], Callable[[str | None], np.ndarray]]) -> Callable[[str | None], float]:
    """text -> probability of label 1: a sparse dot product over its distinct slots."""
    dense = np.zeros(1 << BITS, np.float32)
    dense[model["slots"]] = model["weights"]
    used = dense != 0
    make, w0 = features(), model["intercept"]

    def score(text: str | None) -> float:
        x = make(text)
        x = np.unique(x[used[x]])
        return float(1.0 / (1.0 + np.exp(-np.clip(w0 + dense[x].sum(dtype=np.float64), -30, 30))))

    return score
