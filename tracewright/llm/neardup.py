"""Near duplicates: improved consistent weighted sampling over TF-IDF shingles.

Shingles are five words. A shingle weighs (1 + ln tf) * idf. Document frequencies are counted
over all distinct texts, in ``CELLS`` hashed cells. idf is 1 up to a share of
``COMMON_SHARE`` of the texts (what other shingles add to a cell is about half of that) and
falls with the logarithm of the share to ``LEAST_IDF`` for shingles of all texts. So
boilerplate counts less, but a group of near copies, however large, doesn't weigh down the
shingles its members share so far that they no longer look alike.

Each distinct text has ``BANDS * ROWS`` samples; texts that agree in a band meet in a bucket.
1. Every text is compared with its buckets' pivots: of a bucket, the text with most copies.
2. Texts of a bucket that are still in different components are compared with each other,
   in blocks of ``BLOCK`` texts, so that no task holds a bucket; nothing is dropped by size.
Weighted Jaccard similarity of at least ``THRESHOLD`` links two texts; classes are the
connected components of the links. Exact copies are found by their text and compared once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MIX, Spans, giving_back, hash_words, read, reliable_checkpoint, small_batches, split_words, text_runs

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 4
CELL_BITS = 18
CELLS = 1 << CELL_BITS
#: Blocks of cells, and tasks whose counts are added in one go.
BLOCKS, FAN = 16, 64
LEAST_IDF = 0.75
COMMON_SHARE = 1 / 256
#: Texts that a group of comparisons has on either side, at most.
BLOCK = 256
TABLE = 1 << 16
#: Shingles sampled or compared in one go.
AT_ONCE = 400_000
#: What lies between words.
BREAKS = r"[^\pL\pN_]+"
NO_ID = -(2**63)


def shingles_of(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct shingle hashes, ascending; how often each occurs) of each text. Texts of fewer
    than five words have one shingle of all their words; texts without words none."""
    words, owner = split_words(texts, BREAKS)
    spans = Spans(hash_words(words))
    n = np.bincount(owner, minlength=len(texts))
    ends = np.cumsum(n)
    out = []
    for first, end in zip((ends - n).tolist(), ends.tolist()):
        if end - first > WORDS:
            at = np.arange(first, end - WORDS + 1)
            h = np.sort(spans.hashes(at, at + WORDS))
            edges = np.flatnonzero(h[1:] != h[:-1]) + 1
            if len(edges) + 1 == len(h):
                out.append((h, np.ones(len(h), np.int64)))
            else:
                edges = np.concatenate([[0], edges])
                out.append((h[edges], np.diff(edges, append=len(h))))
        elif end > first:
            out.append((spans.hashes(np.array([first]), np.array([end])), np.ones(1, np.int64)))
        else:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    return out


def cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def weights_of(h: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1.0 + np.log(counts)) * idf[cell(h)]


def idf_of(frequency: np.ndarray, n: int) -> np.ndarray:
    """Inverse document frequencies, from LEAST_IDF to 1, of cells over n texts."""
    share = np.clip(frequency / max(1, n), COMMON_SHARE, 1.0)
    return 1.0 - (1.0 - LEAST_IDF) * np.log(share / COMMON_SHARE) / np.log(1.0 / COMMON_SHARE)


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """How many of the texts have a shingle in each cell.

    A task counts into CELLS numbers and sends them in BLOCKS blocks; FAN tasks' blocks are
    added at a time, level by level, so no task adds more than FAN blocks at any input size.
    The driver gets CELLS numbers."""

    def count(batches: Iterator) -> Iterator:
        cells = np.zeros(CELLS, np.int64)
        for batch in text_runs(batches, 0):
            made = [cell(h) for h, _ in shingles_of(batch.column(0))]
            if made:
                cells += np.bincount(np.concatenate(made), minlength=CELLS)
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"task": pa.array([task] * BLOCKS, pa.int32()), "block": pa.array(range(BLOCKS), pa.int32()), "cells": pa.array([p.astype("<i8").tobytes() for p in np.split(cells, BLOCKS)], pa.binary())})

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS // BLOCKS, np.int64)
        for batch in batches:
            for cells in batch.column(batch.schema.get_field_index("cells")).to_pylist():
                total += np.frombuffer(cells, "<i8")
        yield pa.RecordBatch.from_pydict({"task": pa.array([key[1].as_py()], pa.int32()), "block": pa.array([key[0].as_py()], pa.int32()), "cells": pa.array([total.tobytes()], pa.binary())})

    schema = "task int, block int, cells binary"
    tasks = max(1, texts.rdd.getNumPartitions())
    sums = texts.select("text").mapInArrow(giving_back(count), schema)
    while True:
        sums = sums.withColumn("task", F.floor(F.col("task") / FAN).cast("int")).groupBy("block", "task").applyInArrow(add, schema)
        tasks = -(-tasks // FAN)
        if tasks <= 1:
            break
    found = {}
    for r in sums.collect():
        x = np.frombuffer(r["cells"], "<i8")
        found[r["block"]] = found.get(r["block"], 0) + x
    return np.concatenate([found[b] for b in range(BLOCKS)]) if found else np.zeros(CELLS, np.int64)


class Sampler:
    """Consistent weighted samples. The random variables of a shingle and a sample come from
    tables of TABLE entries, chosen by bits of the shingle's hash."""

    def __init__(self, idf: np.ndarray, number: int = BANDS * ROWS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.idf, self.number = idf, number
        # half precision keeps the tables small; every task reads the same values
        self.r = rng.gamma(2.0, 1.0, (number, TABLE)).astype(np.float16)
        self.c = np.log(rng.gamma(2.0, 1.0, (number, TABLE))).astype(np.float16)
        self.beta = rng.random((number, TABLE)).astype(np.float16)
        self.odd = [np.uint64(int(x) | 1) for x in rng.integers(1 << 62, (1 << 63) - 1, number)]
        zero = np.zeros(TABLE, np.float32)
        self.plain = [self.sortable(self.log_a(k, np.arange(TABLE), zero)) for k in range(number)]

    def log_a(self, k: int, at: np.ndarray, log_s: np.ndarray) -> np.ndarray:
        r, beta = np.maximum(self.r[k][at].astype(np.float32), np.float32(1e-3)), self.beta[k][at].astype(np.float32)
        t = np.floor(log_s / r + beta)
        return self.c[k][at] - r * (t - beta) - r

    @staticmethod
    def sortable(a: np.ndarray) -> np.ndarray:
        """Floats as unsigned numbers of the same order."""
        bits = np.ascontiguousarray(a, np.float32).view(np.uint32)
        flipped = np.where(bits >> np.uint32(31) == 1, ~bits, bits | np.uint32(0x80000000))
        return flipped.astype(np.uint32)

    def samples(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
        """One array (a value for each text) for each sample; texts have shingles. A sample is
        the least a of a text with its shingle's hash: a tells t apart as well."""
        h = np.concatenate([x for x, _ in texts])
        starts = np.concatenate([[0], np.cumsum([len(x) for x, _ in texts])[:-1]])
        w = weights_of(h, np.concatenate([n for _, n in texts]), self.idf)
        others = np.flatnonzero(w != 1.0)
        log_s = np.log(w[others]).astype(np.float32)
        low = h >> np.uint64(32)
        for k in range(self.number):
            at = (h * self.odd[k] >> np.uint64(48)).astype(np.int64)
            a = self.plain[k][at]
            if len(others):
                a[others] = self.sortable(self.log_a(k, at[others], log_s))
            yield np.minimum.reduceat(a.astype(np.uint64) << np.uint64(32) | low, starts)

    def bands(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Band hashes, one row for each text."""
        out = np.empty((len(texts), BANDS), np.uint64)
        for k, least in enumerate(self.samples(texts)):
            if k % ROWS == 0:
                mixed = np.full(len(texts), k // ROWS + 1, np.uint64)
            mixed = (mixed ^ least) * MIX[k % 4]
            mixed ^= mixed >> np.uint64(29)
            out[:, k // ROWS] = mixed * MIX[4]
        return out.view(np.int64)


_sampler: tuple | None = None


def sampler_of(idf: np.ndarray) -> Sampler:
    """The sampler of this process: the next task of a worker uses the same tables."""
    global _sampler
    mark = hash(idf.tobytes())
    if _sampler is None or _sampler[0] != mark:
        _sampler = (mark, Sampler(idf))
    return _sampler[1]


def sketched(texts: DataFrame, shared) -> DataFrame:
    """key, bands (array of hashes) for each text that has shingles."""

    def run(batches: Iterator) -> Iterator:
        sampler = sampler_of(shared.value)

        def done(keys, made):
            bands = pa.FixedSizeListArray.from_arrays(pa.array(sampler.bands(made).ravel()), BANDS).cast(pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), bands], names=["key", "bands"])

        keys, made, n = [], [], 0
        for batch in text_runs(batches, 1):
            for key, shingles in zip(batch.column(0).to_pylist(), shingles_of(batch.column(1))):
                if not len(shingles[0]):
                    continue
                keys.append(key)
                made.append(shingles)
                n += len(shingles[0])
                if n >= AT_ONCE:
                    yield done(keys, made)
                    keys, made, n = [], [], 0
        if made:
            yield done(keys, made)

    return texts.select("key", "text").mapInArrow(giving_back(run), "key binary, bands array<long>")


def compared(asking: DataFrame, asked: DataFrame, shared, threshold: float) -> DataFrame:
    """(a, b): the similar ones of all pairs of an asking and an asked text of one group.

    Rows: g (the group), key, text, root, inside, band, bands. Pairs of one root are passed
    over, and pairs that share a bucket of an earlier band; of asked texts that are not
    ``inside`` only those of a larger key count, as they ask too. A group's asking texts are
    held by its task, its asked ones go by."""
    columns = ["g", "asks", "key", "text", "root", "inside", "band", "bands"]
    rows = asking.withColumn("asks", F.lit(True)).select(columns).unionByName(asked.withColumn("asks", F.lit(False)).select(columns))
    dealt = rows.repartition("g").sortWithinPartitions("g", F.desc("asks"))

    def run(batches: Iterator) -> Iterator:
        idf = shared.value
        group, outer, ys, size = None, [], [], 0
        a: list[bytes] = []
        b: list[bytes] = []

        def compare():
            h, w = np.concatenate([y[-2] for y in ys]), np.concatenate([y[-1] for y in ys])
            owner = np.repeat(np.arange(len(ys)), [len(y[-2]) for y in ys])
            sums, order = np.bincount(owner, w, len(ys)), np.argsort(h, kind="stable")
            h, w, owner = h[order], w[order], owner[order]
            for key, root, _, band, bands, hx, wx in outer:
                first, n = np.searchsorted(h, hx), np.searchsorted(h, hx, "right")
                n -= first
                hits = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                # all sums run over ascending hashes, so they are the same from either side
                low = np.bincount(owner[hits], np.minimum(w[hits], np.repeat(wx, n)), len(ys))
                own = np.bincount(np.zeros(len(wx), np.int64), wx)[0]
                for k in np.flatnonzero((low > 0) & (low >= (threshold - 1e-9) * (own + sums - low))):
                    other, root_y, inside, _, bands_y, _, _ = ys[k]
                    if root != root_y and (inside or other > key) and not (bands and any(p == q for p, q in zip(bands[:band], bands_y[:band]))):
                        a.append(min(key, other))
                        b.append(max(key, other))

        for batch in text_runs(batches, 3):
            made = shingles_of(batch.column(3))
            for g, asks, key, root, inside, band, bands, (h, n) in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5, 6, 7)), made):
                if g != group or size >= AT_ONCE:
                    if ys:
                        compare()
                    ys, size = [], 0
                    if g != group:
                        group, outer = g, []
                row = (key, root, inside, band, bands, h, weights_of(h, n, idf))
                if asks:
                    outer.append(row)
                else:
                    ys.append(row)
                    size += len(h)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
                a.clear(), b.clear()
        if ys:
            compare()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return dealt.mapInArrow(giving_back(run), "a binary, b binary")


def pivot_pairs(met: DataFrame, texts: DataFrame, shared, threshold: float) -> DataFrame:
    """The similar ones of the pairs of a text and a pivot of its buckets.

    ``met``: key, pivot, size (of the bucket). The texts of a pivot are cut into groups of
    about BLOCK, each with a copy of the pivot."""
    pairs = reliable_checkpoint(met.where("key <> pivot").groupBy("key", "pivot").agg(F.ceil(F.max("size") / BLOCK).cast("int").alias("parts")))
    pivots = pairs.groupBy("pivot").agg(F.max("parts").alias("parts")).join(texts, F.col("pivot") == F.col("key"))
    group = F.concat(F.col("pivot"), F.hex("part").cast("binary"))
    none = [F.col("key").alias("root"), F.lit(True).alias("inside"), F.lit(0).alias("band"), F.lit(None).cast("array<long>").alias("bands")]
    asking = pivots.select("pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "key", "text")
    asked = pairs.join(texts, "key").select("pivot", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), "key", "text")
    return compared(*[side.select(group.alias("g"), "key", "text", *none) for side in (asking, asked)], shared, threshold)


def bucket_pairs(members: DataFrame, texts: DataFrame, shared, threshold: float) -> DataFrame:
    """The similar ones of the pairs of a bucket's texts that are in different components.

    ``members``: band, h, key, root, main (the bucket's most frequent root), size, outside
    (texts of other roots), bands. A text outside the main component is compared with all of
    other components, in the first bucket that the two share. The texts outside are cut into
    parts, all texts into blocks, and every part and block is a group of its own."""
    blocks, parts = F.ceil(F.col("size") / BLOCK).cast("int"), F.ceil(F.col("outside") / BLOCK).cast("int")
    at = members.withColumn("inside", F.col("root") == F.col("main")).join(texts, "key")
    asking = at.where("NOT inside").withColumn("part", F.pmod(F.xxhash64("key"), parts).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    asked = at.withColumn("block", F.pmod(F.xxhash64("key"), blocks).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    group = F.concat_ws(":", "band", "h", "part", "block").cast("binary")
    return compared(*[side.withColumn("g", group) for side in (asking, asked)], shared, threshold).distinct()


def components(edges: DataFrame) -> DataFrame:
    """key, root (least key of its component) for every key that has an edge.

    Each round takes the least root among the neighbours and then the root's own root;
    rounds are checkpointed and end when no root changes."""
    both = reliable_checkpoint(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "key")
    roots = reliable_checkpoint(roots)
    while True:
        near = both.join(roots, both["b"] == roots["key"]).groupBy("a").agg(F.min("root").alias("near"))
        stepped = roots.join(near, roots["key"] == near["a"]).select("key", "root", F.least("root", "near").alias("next"))
        jumped = stepped.join(roots.select(F.col("key").alias("next"), F.col("root").alias("far")), "next", "left")
        moved = reliable_checkpoint(jumped.select("key", F.col("root").alias("old"), F.least(F.col("next"), F.col("far")).alias("root")))
        roots = moved.select("key", "root")
        if moved.where("old <> root").isEmpty():
            return roots


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty), key (of the text) and rid (doc_id, or a stand-in)."""
    rows = small_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("key", F.unhex(F.md5("text"))).withColumn("rid", F.coalesce("doc_id", F.lit(NO_ID)).cast("long"))


class TextTable:
    """The distinct texts (key, text), written once, in buckets of their key, to the shared
    folder: two passes read them, and joins by key move only their other side."""

    def __init__(self, base: DataFrame):
        self.spark = base.sparkSession
        reliable_checkpoint(self.spark.range(0))  # sets the shared folder
        self.name = f"distinct_texts_{uuid.uuid4().hex}"
        self.path = f"{self.spark.sparkContext.getCheckpointDir()}/{self.name}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        once = base.select("key", "text").dropDuplicates(["key"])  # copies go before the exchange
        once.write.bucketBy(buckets, "key").option("path", self.path).option("compression", "zstd").saveAsTable(self.name, format="parquet")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def members(base: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each text of ``keyed`` rows: key, class_id, rep (key of the text that holds
    class_id), class_size (rows), verified_links."""
    copies = reliable_checkpoint(base.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    table = TextTable(base)
    texts = table.rows()
    shared = base.sparkSession.sparkContext.broadcast(idf_of(document_frequencies(texts), copies.count()))
    nodes = reliable_checkpoint(copies.select("key", "n").join(sketched(texts, shared), "key"))
    spread = nodes.select("key", "n", F.posexplode("bands").alias("band", "h"))

    buckets = spread.groupBy("band", "h").agg(F.max(F.struct("n", "key"))["key"].alias("pivot"), F.count("*").alias("size")).where("size > 1")
    buckets = reliable_checkpoint(buckets)  # a join of two exchanges can split a hot bucket
    met = reliable_checkpoint(spread.join(buckets, ["band", "h"]).select("key", "band", "h", "pivot", "size"))
    edges = reliable_checkpoint(pivot_pairs(met.select("key", "pivot", "size"), texts, shared, threshold))
    roots = components(edges)

    labelled = reliable_checkpoint(met.join(roots, "key", "left").select("key", "band", "h", "size", F.coalesce("root", "key").alias("root")))
    counted = labelled.groupBy("band", "h", "root").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    mixed = counted.groupBy("band", "h").agg(F.count("*").alias("roots"), F.max("size").alias("size"), F.max(F.struct("n", "root")).alias("most")).where("roots > 1")
    mixed = reliable_checkpoint(mixed.select("band", "h", F.col("most.root").alias("main"), (F.col("size") - F.col("most.n")).alias("outside")))
    open_ = reliable_checkpoint(labelled.join(mixed, ["band", "h"]))
    more = reliable_checkpoint(bucket_pairs(open_.join(nodes.select("key", "bands"), "key"), texts, shared, threshold))
    if not more.isEmpty():
        edges = edges.unionByName(more)
        roots = components(edges)
    table.drop()

    links = edges.distinct().select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("verified_links"))
    rooted = copies.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    best = F.min(F.struct(F.col("first").isNull().alias("none"), "first", "key"))
    groups = rooted.groupBy("root").agg(best.alias("best"), F.sum("n").alias("class_size"))
    groups = reliable_checkpoint(groups.select("root", F.col("best.first").alias("class_id"), F.col("best.key").alias("rep"), "class_size"))
    return rooted.join(groups, "root").join(links, "key", "left").select("key", "class_id", "rep", "class_size", F.coalesce("verified_links", F.lit(0)).cast("long").alias("verified_links"))


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (least doc_id of the class), class_size (rows), verified_links (of its
    text to different texts, those compared to find the classes: texts already in one class
    are not compared with each other): one row for each row.

    Null texts count as empty; equal texts, the empty one too, are one class; texts without
    words link to none but their copies. Null doc_ids take part; class_id is null where a
    class has no doc_id. Repeated rows each get their row. Other columns are ignored.
    """
    base = keyed(docs)
    found = reliable_checkpoint(members(base, threshold))
    return base.select("doc_id", "key").join(found, "key").select("doc_id", "class_id", "class_size", "verified_links")


def keep_first(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, that of its least doc_id (a row without one only where the
    class has none); all columns stay, whatever their names. Of repeated rows one stays."""
    kept = members(keyed(docs), threshold).where(F.col("key") == F.col("rep")).select(F.coalesce("class_id", F.lit(NO_ID)).cast("long").alias("rid"), "key")
    rows = docs.select(F.struct("*").alias("row"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key"), F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("rid"))
    # grouping by the join's keys needs no other exchange of the texts
    return rows.join(reliable_checkpoint(kept), ["key", "rid"], "left_semi").dropDuplicates(["key", "rid"]).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents"))
