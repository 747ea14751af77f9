"""Language identification: words first, then ever shorter character n-grams.

A word that the model knows adds its smoothed log frequency in each language. A word that
it doesn't know is cut into its longest character n-grams (with word ends marked); the
first length at which any n-gram is known decides, by the mean of all known n-grams of that
length, down to single characters. The languages' sums are compared; equal priors.

The model is a sorted array of hashes for words and for each length of n-grams, with the
(language, log frequency) pairs of each entry; every language seen, every word seen twice
and every n-gram of the sample are in it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Spans, bounded_sample, crc_remainder, giving_back, hash_words, read, small_batches, split_words, text_runs

#: What lies between words: anything but letters.
BREAKS = r"[^\pL]+"
ORDERS = (5, 4, 3, 2, 1)
#: Documents to learn from, at most: the only bound on the model's size.
SAMPLE_DOCS = 6000
#: Numbers of a score table made at once.
TABLE = 1 << 22
#: Characters of unseen words cut into n-grams at once.
CHARACTERS = 1 << 20
#: Words that count in full as evidence; beyond, the mean of all words counts so often.
EVIDENCE = 16
UNKNOWN = "und"
MIN_SCORE = 0.5
#: Smoothing of counts and of totals.
LEAST_COUNT, EXTRA_TOTAL = 0.01, 1000.0


class Cut:
    """The code points of words, each word with its ends marked, and hashes of its n-grams."""

    def __init__(self, words: pa.Array):
        marked = pc.binary_join_element_wise(pa.scalar("<", words.type), words, pa.scalar(">", words.type), pa.scalar("", words.type))
        points = np.frombuffer("".join(marked.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.lengths = pc.utf8_length(marked).to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.spans = Spans(points)

    def grams(self, which: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of the n-grams of the words ``which``, index into ``which`` of each)."""
        n = np.maximum(self.lengths[which] - order + 1, 0)
        owner = np.repeat(np.arange(len(which)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.starts[which][owner]
        return self.spans.hashes(at, at + order), owner


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, modulus: int = 5, held: int = 0) -> dict:
    """Learns from text and lang of rows whose crc32(doc_id as text) % modulus isn't ``held``.

    At most about ``sample_docs`` documents (smallest hash of doc_id). Tasks send counts of
    hashes, so the driver gets as many rows as the sample has different words and n-grams.
    """
    usable = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_remainder("doc_id", modulus) != held))
    sample = bounded_sample(usable, "doc_id", sample_docs).select("lang", "text")

    def count(batches: Iterator) -> Iterator:
        tally: dict[str, Counter] = {}
        for batch in text_runs(batches, 1):
            words, owner = split_words(batch.column(1), BREAKS)
            langs = batch.column(0).take(pa.array(owner, pa.int64()))
            for lang in pc.unique(langs).to_pylist():
                seen = words.filter(pc.equal(langs, lang)).value_counts()
                tally.setdefault(lang, Counter()).update(dict(zip(seen.field(0).to_pylist(), seen.field(1).to_pylist())))
        for lang, counted in tally.items():
            names, times = pa.array(counted.keys(), pa.large_string()), np.fromiter(counted.values(), np.int64)
            cut = Cut(names)
            for order in (0, *ORDERS):
                if order:
                    h, owner = cut.grams(np.arange(len(names)), order)
                    own, at = np.unique(h, return_inverse=True)
                    n = np.bincount(at, times[owner], len(own)).astype(np.int64)
                else:
                    own, n = hash_words(names), times
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(own), pa.string()), "kind": pa.array([order] * len(own), pa.int32()), "h": own.view(np.int64), "n": n})

    counted = small_batches(sample).mapInArrow(giving_back(count), "lang string, kind int, h long, n long").groupBy("lang", "kind", "h").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(pc.unique(counted["lang"]).to_pylist())
    lang = pc.index_in(counted["lang"], pa.array(names, pa.string())).to_numpy(zero_copy_only=False).astype(np.int64)
    kind, n, h = counted["kind"].to_numpy(), counted["n"].to_numpy(), counted["h"].to_numpy().view(np.uint64)
    model: dict = {"languages": names, "kinds": {}}
    for k in (0, *ORDERS):
        own = kind == k
        sums = np.bincount(lang[own], n[own], len(names)) + EXTRA_TOTAL
        own &= (n > 1) | (k > 0)
        order = np.lexsort((lang[own], h[own]))
        hs, ls, ns = h[own][order], lang[own][order], n[own][order]
        keys, first = np.unique(hs, return_index=True)
        # what a language's count adds to the logarithm of LEAST_COUNT / total
        gain = np.log((ns + LEAST_COUNT) / LEAST_COUNT).astype(np.float32)
        model["kinds"][k] = {"keys": keys, "first": np.append(first, len(hs)).astype(np.int64), "lang": ls.astype(np.int32), "gain": gain, "base": np.log(LEAST_COUNT / sums)}
    return model


class Scores:
    """Vectors of log frequencies (a number for each language) of words."""

    def __init__(self, model: dict):
        self.kinds, self.width = model["kinds"], len(model["languages"])

    def find(self, k: int, h: np.ndarray) -> np.ndarray:
        """Places of hashes among the entries of a kind; -1 for unknown ones."""
        keys = self.kinds[k]["keys"]
        if not len(keys):
            return np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, at, -1)

    def summed(self, k: int, at: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
        """Sums over entries ``at``, by owner: a rows x width table."""
        kind = self.kinds[k]
        n = kind["first"][at + 1] - kind["first"][at]
        places = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(kind["first"][at], n)
        cells = np.repeat(owner, n) * self.width + kind["lang"][places]
        out = np.bincount(cells, kind["gain"][places], rows * self.width).reshape(rows, self.width)
        return out + np.bincount(owner, minlength=rows)[:, None] * kind["base"]

    def vectors(self, words: pa.Array) -> np.ndarray:
        """A row for each word."""
        at = self.find(0, hash_words(words))
        known = np.flatnonzero(at >= 0)
        out = np.zeros((len(words), self.width))
        out[known] = self.summed(0, at[known], np.arange(len(known)), len(known))
        unseen = np.flatnonzero(at < 0)
        if not len(unseen):
            return out
        cut = Cut(words.take(pa.array(unseen)))
        open_ = np.arange(len(unseen))
        for order in ORDERS:
            left = []
            part = np.cumsum(cut.lengths[open_]) // CHARACTERS
            for which in np.split(open_, np.flatnonzero(np.diff(part)) + 1):
                if not len(which):
                    continue
                h, owner = cut.grams(which, order)
                at = self.find(order, h)
                hit = at >= 0
                n = np.bincount(owner[hit], minlength=len(which))
                some = n > 0
                sums = self.summed(order, at[hit], owner[hit], len(which))
                out[unseen[which[some]]] = sums[some] / n[some, None]
                left.append(which[~some])
            open_ = np.concatenate(left) if left else open_[:0]
            if not len(open_):
                break
        return out

    def totals(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(sum of the vectors of a text's words, number of its words), a row for each text.

        Each distinct word of a run of words is looked up once."""
        words, owner = split_words(texts, BREAKS)
        out, n = np.zeros((len(texts), self.width)), np.bincount(owner, minlength=len(texts))
        step = max(1000, TABLE // max(1, self.width))
        for a in range(0, len(words) if self.width else 0, step):
            coded = words.slice(a, step).dictionary_encode()
            own = owner[a : a + step]
            rows = self.vectors(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            out[own[starts]] += np.add.reduceat(rows, starts, axis=0)
        return out, n


def predictor(model: dict):
    """texts -> (languages or ``und``, probabilities). Ties go to the first language by name."""
    scores = Scores(model)
    names = np.array([*model["languages"], UNKNOWN], object)

    def predict(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not scores.width:
            return np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        total, n = scores.totals(texts)
        mean = total / np.maximum(n, 1)[:, None] * np.minimum(n, EVIDENCE)[:, None]
        p = np.exp(mean - mean.max(1, keepdims=True))
        # words come in other orders in other runs, which shows in the last digits only
        p = np.round(p / p.sum(1, keepdims=True), 9)
        best = p.argmax(1)
        return names[np.where(n > 0, best, len(names) - 1)], np.where(n > 0, p[np.arange(len(p)), best], 0.0)

    return predict


def identify(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row for each row.

    Null texts and texts without a letter are ``und`` with score 0, and so is every text if
    there was nothing to learn from. held_out is null for a null doc_id. Repeated rows are
    scored each; other columns are ignored.
    """
    model = train(docs) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        predict = predictor(shared.value)
        for batch in text_runs(batches, 2):
            lang, score = predict(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = small_batches(docs).select(F.col("doc_id").cast("long"), (crc_remainder("doc_id", 5) == 0).alias("held_out"), "text")
    return rows.mapInArrow(giving_back(run), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: dict | None = None, least: float = MIN_SCORE) -> DataFrame:
    """The rows whose language is found with a score of at least ``least``; all columns."""
    model = train(docs) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator) -> Iterator:
        predict = predictor(shared.value)
        for batch in text_runs(batches, at):
            lang, score = predict(batch.column(at))
            yield batch.filter(pa.array((lang != UNKNOWN) & (score >= least), pa.bool_()))

    return small_batches(docs).mapInArrow(giving_back(run), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))
