"""Document fingerprints: signatures of spots around common words.

A spot is a common (anchor) word with the next content words after it; other common
words in between are skipped. The distinct spots of a text form its fingerprint. Texts
without a spot take their content words (or, without any, all words) as signatures, so
only texts without any word have an empty fingerprint.

All paths are DataFrame expressions: no Python on the executors.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let, read

#: Common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be but by for from had has have in is it its not of on or that the their there they this to was were which will with "
    "au aux avec ce ces dans de des du elle en est et il la le les ne par pas pour que qui se ses son sur un une "
    "als auch auf aus bei das dem den der die durch ein eine einer er es im ist mit nach nicht sich sie sind und von zu zum zur "
    "al como con del el las lo los más no para pero por su sus una y"
).split()
ANCHORS = tuple(dict.fromkeys(ANCHORS))

CHAIN = 2
THRESHOLD = 0.8


def words_of(text: Column) -> Column:
    """Lower-case words (letters and digits); null counts as empty."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def spots(words: Column, anchors=ANCHORS, chain: int = CHAIN) -> Column:
    """Sorted distinct signature hashes of an array of words."""
    listed = list(anchors)

    def from_parts(p: Column) -> Column:
        content, marks = p["content"], p["marks"]
        full = F.filter(marks, lambda x: x["at"] + chain <= F.size(content))
        return F.transform(full, lambda x: F.xxhash64(x["w"], *[F.get(content, x["at"] + j) for j in range(chain)]))

    def single(ws: Column) -> Column:
        return F.transform(ws, lambda w: F.xxhash64(w))

    def from_words(ws: Column) -> Column:
        heads = F.filter(F.transform(ws, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(listed))
        # the k-th anchor, at position i, has i - k content words before it
        marks = F.transform(heads, lambda x, k: F.struct(x["w"].alias("w"), (x["i"] - k).alias("at")))
        parts = F.struct(F.filter(ws, lambda w: ~w.isin(listed)).alias("content"), marks.alias("marks"))
        return let(parts, lambda p: let(from_parts(p), lambda made: F.when(F.size(made) > 0, made).when(F.size(p["content"]) > 0, single(p["content"])).otherwise(single(ws))))

    return F.array_sort(F.array_distinct(let(words, from_words)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two distinct arrays; two empty ones are alike (1)."""
    def ratio(both: Column) -> Column:
        union = F.size(a) + F.size(b) - both
        return F.when(union == 0, F.lit(1.0)).otherwise(both / union).cast("double")

    return let(F.size(F.array_intersect(a, b)), ratio)


def digest(signatures: Column) -> Column:
    """Fingerprint as text: how many signatures, and a hash of all of them."""
    return F.concat_ws(":", F.size(signatures).cast("string"), F.sha2(F.array_join(F.transform(signatures, lambda x: F.hex(x)), ",").cast("binary"), 256))


def fingerprints(docs: DataFrame, anchors=ANCHORS, chain: int = CHAIN) -> DataFrame:
    """doc_id, signatures (sorted distinct), fingerprint. One row for each input row."""
    rows = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    marked = rows.select("doc_id", spots(F.col("words"), anchors, chain).alias("signatures"))
    return marked.select("doc_id", "signatures", digest(F.col("signatures")).alias("fingerprint"))


#: Hashed cells in which signatures are counted, to put rare ones first.
CELLS = 1 << 16


def similar_pairs(docs: DataFrame, threshold: float = THRESHOLD, anchors=ANCHORS, chain: int = CHAIN) -> DataFrame:
    """Pairs of different fingerprints with Jaccard similarity of at least ``threshold``.

    Equal fingerprints form a class, kept once under its smallest doc_id; the result has
    ``a``, ``b`` (class ids, a < b) and ``similarity``. Classes are dealt into partitions
    of set length, so wide that partners lie in the same or the next one. Inside, only sets
    that share one of their rarest signatures (prefix filter: the first
    ``n - ceil(t * n) + 1`` in an order by hashed corpus frequency, which any order makes exact)
    and whose lengths allow the threshold meet; the similarity is then exact. No cap on
    partners; empty sets pair with none.
    """
    prints = fingerprints(docs, anchors, chain).where(F.size("signatures") > 0)
    classes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("id"), F.first("signatures").alias("signatures"))
    cell = lambda s: F.pmod(s, F.lit(CELLS)).cast("int")
    counts = np.zeros(CELLS, np.int64)
    for r in classes.select(F.explode("signatures").alias("s")).groupBy(cell(F.col("s")).alias("c")).count().collect():  # CELLS rows at most
        counts[r["c"]] = r["count"]
    listed = F.lit(counts)
    ranked = F.array_sort(F.transform("signatures", lambda s: F.struct(F.get(listed, cell(s)).alias("n"), s.alias("s"))))
    prefix = F.size("signatures") - F.ceil(F.size("signatures") * threshold - 1e-9).cast("int") + 1
    ordered = classes.select("id", F.size("signatures").alias("size"), F.explode(F.transform(F.slice(ranked, 1, prefix), lambda x: x["s"])).alias("s"))
    ordered = ordered.withColumn("band", F.floor(F.log(F.col("size").cast("double")) / F.lit(-math.log(threshold))))
    left = ordered.select(*[F.col(c).alias(f"l_{c}") for c in ordered.columns])
    right = ordered.select(*[F.col(c).alias(f"r_{c}") for c in ordered.columns if c != "band"], F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("r_band"))
    met = left.join(
        right,
        (F.col("l_s") == F.col("r_s")) & (F.col("l_band") == F.col("r_band")) & (F.col("l_size") <= F.col("r_size")) & (F.col("l_id") != F.col("r_id")) & (F.col("l_size") >= F.col("r_size") * threshold),
    )
    met = met.where((F.col("l_size") < F.col("r_size")) | (F.col("l_id") < F.col("r_id")))
    pairs = met.select(F.least("l_id", "r_id").alias("a"), F.greatest("l_id", "r_id").alias("b")).distinct()
    sets = classes.select("id", "signatures")
    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("signatures").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("signatures").alias("sb")), "b")
    return joined.select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("similarity")).where(F.col("similarity") >= threshold)


#: Ranges of doc_id, at most: of 10^10 documents each holds 150,000, which a sort spills.
RANGES = 65_536


def range_of(key: Column, bounds: list[int]) -> Column:
    """Place of the last bound not above ``key`` (bounds ascend, the first is the least key): a
    binary search in one array, which is part of the plan."""
    listed = F.lit(np.array(bounds, np.int64))
    steps = [1 << i for i in reversed(range(max(1, (len(bounds) - 1).bit_length())))]
    return F.aggregate(
        F.array(*[F.lit(x) for x in steps]),
        F.lit(0),
        lambda at, step: F.when((at + step < len(bounds)) & (F.get(listed, at + step) <= key), at + step).otherwise(at),
    )


def with_next(rows: DataFrame, columns: list[str], per_bucket: int = 2000, made: dict[str, Column] | None = None) -> DataFrame:
    """Adds the columns ``made``, and ``next_<c>`` for each of ``columns``: the values in the
    following row.

    Rows are ordered by doc_id (null first), equal ids by text; after the last row comes the
    first. Rows are dealt into ranges of doc_id whose bounds are values of the data; each range
    also gets a copy of the row that opens the next one. Only the bounds reach the driver, at
    most RANGES of them. ``made`` is computed after rows are dealt, so it isn't shuffled. Rows
    may have any columns.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    buckets = max(1, min(RANGES, rows.count() // per_bucket))
    shares = [i / buckets for i in range(1, buckets)]
    first, inner = rows.agg(F.min(key), F.percentile_approx(key, shares, max(20_000, 2 * buckets)) if shares else F.lit(None)).first()
    if first is None:
        return rows.withColumns(made or {}).select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    bounds = sorted({first, *(inner or [])})
    dealt = rows.select(F.struct("*").alias("row"), key.alias("key"), range_of(key, bounds).alias("bucket"), F.lit(0).alias("copy"))
    opening = dealt.where(F.col("key").isin(bounds)).withColumn("bucket", (F.col("bucket") + len(bounds) - 1) % len(bounds)).withColumn("copy", F.lit(1))
    spread = dealt.unionByName(opening).repartition("bucket").select("row.*", F.struct("key", "bucket", "copy").alias("__place"))
    spread = spread.withColumns(made or {})
    order = Window.partitionBy("__place.bucket").orderBy("__place.copy", "__place.key", "text")
    led = spread.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return led.where("__place.copy = 0").drop("__place")


def compare(docs: DataFrame, anchors=ANCHORS, chain: int = CHAIN) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text is the text with its last floor(n/2) code points replaced by the
    first as many of the next document. Null texts count as empty. A single document is
    its own next. Repeated doc_ids follow each other by text. Other columns are ignored.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows, ["text", "signatures"], made={"signatures": spots(words_of(F.col("text")), anchors, chain)})
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.left(F.col("text"), F.length("text") - half), F.left(F.col("next_text"), half)))
    rows = rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "signatures",
        "next_signatures",
        spots(words_of(F.col("edited")), anchors, chain).alias("edited_signatures"),
    )
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        digest(F.col("signatures")).alias("fingerprint"),
        digest(F.col("edited_signatures")).alias("edited_fingerprint"),
        likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
        likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(read(spark, sf_dir, "documents"))
