"""Secret scans: fixed patterns, and character Markov models compared by likelihood.

Two first-order Markov chains over characters are trained from labelled samples: one of
random strings (values that the fixed patterns found, and generated keys of the usual
alphabets), one of ordinary identifiers (other tokens of the same texts). A token of
``MIN_LENGTH`` or more characters is a secret if the log-likelihood ratio of the two chains
reaches a threshold. The threshold is fitted on the samples that the chains have not seen (a
quarter, by a hash of the string); its recall and false-positive rate there are part of the
model. Such tokens are spans of their own, whether or not a fixed pattern covers them too.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, giving_back, map_rows, read, small_batches

#: Fixed patterns of the base scan: kind, pattern, least length, group that has the length.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: As long runs only: shorter ones would be dropped, and each lies inside one run.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LENGTH = 6
KINDS = ("assign", "access", "hex", "markov")

MIN_LENGTH = 16
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
IDENTIFIER = re.compile(r"[A-Za-z0-9+/_-]{6,}={0,2}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
PLACE = {c: i for i, c in enumerate(ALPHABET)}
SIZE = len(ALPHABET) + 1  # and one for start

#: Documents whose tokens are labelled samples, at most, and generated keys.
SAMPLE_DOCS = 4000
GENERATED = 3000
#: A wrongly accepted share of the held-out identifiers costs so much more than a missed share of secrets.
FALSE_COST = 10.0
#: Scores are counted by whole nats within these bounds.
LEAST, MOST = -400, 400


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the fixed patterns, sorted."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LENGTH]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    spans.sort()
    return spans


def count_chain(strings, counts: np.ndarray) -> None:
    """Adds the transitions of strings over ``ALPHABET`` to a SIZE x SIZE matrix."""
    last = SIZE - 1
    for s in strings:
        before = last
        for c in s:
            now = PLACE.get(c)
            if now is None:
                continue
            counts[before, now] += 1
            before = now


def generated_secrets(n: int = GENERATED, seed: int = 11) -> list[str]:
    """Random keys: hexadecimal, letters and digits, base64; 20 to 48 characters."""
    rng = random.Random(seed)
    alphabets = ("0123456789abcdef", ALPHABET[:62], ALPHABET[:64])
    return ["".join(rng.choice(alphabets[i % 3]) for _ in range(rng.randint(20, 48))) for i in range(n)]


def ratio_table(random_counts: np.ndarray, plain_counts: np.ndarray) -> np.ndarray:
    """Log ratio of transition probabilities, smoothed by one for each transition."""
    p, q = random_counts + 1.0, plain_counts + 1.0
    return np.log(p / p.sum(1, keepdims=True)) - np.log(q / q.sum(1, keepdims=True))


def held_out(token: str) -> bool:
    """Whether a sample is kept from the chains, to fit the threshold."""
    return xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"), 29) % 4 == 0


def samples(text: str) -> tuple[list[str], list[str]]:
    """(ordinary identifiers, secrets) of a text, as the fixed patterns label them."""
    spans = base_spans(text)
    cut, at = [], 0
    for a, _, b in spans:
        cut.append(text[at:a])
        at = max(at, b)
    cut.append(text[at:])
    return [t for piece in cut for t in IDENTIFIER.findall(piece)], [re.split(r"[\s:=\"']+", text[a:b])[-1] for a, _, b in spans]


def best_threshold(plain: np.ndarray, chance: np.ndarray) -> tuple[float, float, float]:
    """(threshold, recall, false-positive rate) from numbers of held-out samples by nat (LEAST to
    MOST): the least cost of missed and wrongly accepted shares, in the middle of equals. Not
    under 0, where the ordinary chain explains a token better."""
    missed = np.concatenate([[0], np.cumsum(chance)[:-1]]) / max(1, chance.sum())
    wrong = np.cumsum(plain[::-1])[::-1] / max(1, plain.sum())
    cost = missed + FALSE_COST * wrong
    allowed = np.arange(LEAST, MOST + 1) >= 0
    equal = np.flatnonzero(allowed & (cost <= cost[allowed].min() + 1e-12))
    run = equal[: np.argmax(np.diff(equal, append=equal[-1] + 2) > 1) + 1]
    at = int(run[len(run) // 2])
    return float(at + LEAST), float(1 - missed[at]), float(wrong[at])


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict:
    """``table`` of log ratios, ``threshold``, its ``recall`` and ``false_rate``, from the tokens
    of at most about ``sample_docs`` documents (by hash of doc_id).

    Each task sends one SIZE x SIZE matrix for each label, then a count by nat, so sums have
    2 * SIZE * SIZE rows at most. Without documents the ordinary chain is uniform.
    """
    import pyarrow as pa

    sample = small_batches(bounded_sample(docs.select("doc_id", "text").where(F.col("text").isNotNull()), "doc_id", sample_docs)).select("text")

    def summed(make, shape) -> np.ndarray:
        """Sums over tasks of the arrays that ``make(array, text)`` adds to."""

        def count(batches: Iterator) -> Iterator:
            sums = np.zeros(shape)
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    make(sums, text)
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_pydict({"at": at.astype("int64"), "n": sums.ravel()[at]})

        out = np.zeros(shape)
        for r in sample.mapInArrow(giving_back(count), "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect():
            out.ravel()[r["at"]] = r["n"]
        return out

    def chains(sums: np.ndarray, text: str) -> None:
        for label, tokens in enumerate(samples(text)):
            count_chain((t for t in tokens if not held_out(t)), sums[label])

    sums = summed(chains, (2, SIZE, SIZE))
    keys = generated_secrets()
    count_chain((k for k in keys if not held_out(k)), sums[1])
    table = ratio_table(sums[1], sums[0]).tolist()

    def ratios(sums: np.ndarray, text: str) -> None:
        for label, tokens in enumerate(samples(text)):
            add_ratios(sums[label], tokens)

    def add_ratios(sums: np.ndarray, tokens) -> None:
        for t in tokens:
            if len(t) >= MIN_LENGTH and TOKEN.fullmatch(t) and held_out(t):
                sums[min(MOST, max(LEAST, int(np.floor(log_ratio(t, table))))) - LEAST] += 1

    by_nat = summed(ratios, (2, MOST - LEAST + 1))
    add_ratios(by_nat[1], keys)
    threshold, recall, false_rate = best_threshold(by_nat[0], by_nat[1])
    return {"table": table, "threshold": threshold, "recall": recall, "false_rate": false_rate, "held_out": by_nat.sum(1).astype(int).tolist()}


def log_ratio(token: str, table: list[list[float]]) -> float:
    total, row = 0.0, table[SIZE - 1]
    for c in token:
        i = PLACE[c]
        total += row[i]
        row = table[i]
    return total


def all_spans(text: str, model: dict) -> list[tuple[int, int, int]]:
    """Base spans and the tokens that the models find random, by start, then kind."""
    table, threshold = model["table"], model["threshold"]
    more = [(m.start(), 3, m.end()) for m in TOKEN.finditer(text) if log_ratio(m.group(), table) >= threshold]
    return sorted(base_spans(text) + more) if more else base_spans(text)


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long"


def scan(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """One row for each row: counts of the fixed kinds, a digest of their spans, all spans.

    Null texts count as empty: no spans. Null doc_ids and repeated rows keep their rows;
    other columns are ignored.
    """
    model = train(docs) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        model = shared.value

        def one(doc_id, text):
            spans = all_spans(text or "", model)
            base = [s for s in spans if s[1] < 3]
            n = [0, 0, 0, 0]
            for s in spans:
                n[s[1]] += 1
            return doc_id, n[0], n[1], n[2], hashlib.sha256(written(base).encode()).hexdigest(), written(spans), n[3]

        return one

    return map_rows(docs, ["doc_id", "text"], work, SCHEMA)


MARK = "[secret]"


def redacted(text: str | None, model: dict) -> str | None:
    """The text with every span, merged where spans overlap, replaced by ``MARK``."""
    if not text:
        return text
    out, at = [], 0
    for a, _, b in all_spans(text, model):
        if a >= at:
            out += [text[at:a], MARK]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """``docs`` with secrets replaced in ``text`` (and ``n_chars``, where there is such a
    column, counted anew); same rows and columns. Null texts stay null."""
    import pyarrow as pa

    model = train(docs) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index("text")
    types = dict(docs.dtypes)

    def run(batches: Iterator) -> Iterator:
        model = shared.value
        for batch in batches:
            texts = [redacted(t, model) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if types.get("n_chars") == "bigint":
                i = names.index("n_chars")
                columns[i] = pa.array([n if t is None else len(t) for t, n in zip(texts, columns[i].to_pylist())], columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return small_batches(docs).mapInArrow(giving_back(run), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
