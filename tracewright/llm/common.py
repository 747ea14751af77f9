"""Shared helpers of the training-data operators.

Every helper reads through Spark only (no local paths on executors), keeps row
counts exact, and bounds whatever reaches the driver by a stated parameter.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the test data, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows in an Arrow batch: texts may be long, and both sides of the pipe hold a batch.
BATCH_ROWS = 1000
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives executors this package's source files, once for an application."""
    sc = spark.sparkContext
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if sc.applicationId in _shipped or not os.path.isdir(top):
        return
    folder = tempfile.mkdtemp(prefix="package-")
    atexit.register(shutil.rmtree, folder, True)  # executors may fetch it until the end
    path = os.path.join(folder, "tracewright.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(top):
            for f in sorted(files):
                if f.endswith(".py"):
                    z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), os.path.dirname(top)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session now has the package on executors and sends Python batches of
    BATCH_ROWS rows at most."""
    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df


def give_back() -> None:
    """Returns memory that the ended work of a reused Python worker no longer needs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, with ``give_back`` at the end of each task."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage into the shared folder of ``spark.checkpoint.dir``.

    Only in local mode, where that setting may be absent, a temporary folder is used; on a
    cluster no executor could read it, so there the setting is asked for.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def crc_remainder(column: str, modulus: int) -> Column:
    """crc32 of the value written as text, modulo ``modulus`` (null for null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def bounded_sample(df: DataFrame, key: str, bound: int, seed: int = 17) -> DataFrame:
    """At most about ``bound`` rows, those with the smallest hash of ``key``.

    Rows that share a key share its fate; keys that alone hold more than an eighth of the
    bound are left out, and so are null keys. The cut-off is found from the key column: hashes
    under a guess from the number of rows are counted, and only if they are too few (many
    repeated keys) the guess is raised. So what is sorted is in proportion to ``bound``,
    whatever the number of rows or partitions.
    """
    h = F.xxhash64(F.lit(seed), F.col(key))
    keyed = df.where(F.col(key).isNotNull())
    n = keyed.count()
    share = min(1.0, (1.2 * bound + 20.0) / max(1, n))
    while True:
        guess = int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1
        under = sorted((r["h"], r["count"]) for r in keyed.select(h.alias("h")).where(F.col("h") <= F.lit(guess)).groupBy("h").count().collect())
        heavy = [at for at, rows in under if rows > max(1, bound // 8)]
        cut, total = None, 0
        for at, rows in under:
            if rows > max(1, bound // 8):
                continue
            if total + rows > bound:
                break
            cut, total = at, total + rows
        else:
            if share < 1 and total < bound:
                share = min(1.0, 4 * share)
                continue
        if cut is None:
            return keyed.where(F.lit(False))
        inside = h <= F.lit(cut)
        return keyed.where(inside & ~h.isin(heavy) if heavy else inside)


class WordHash(dict):
    """Word to 64-bit hash, remembered for words already seen (bounded)."""

    def __init__(self, bound: int = 150_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: str) -> int:
        if len(self) >= self.bound:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def map_rows(df: DataFrame, columns: list[str], work: Callable[[], Callable[..., tuple]], schema: str) -> DataFrame:
    """``work()`` makes, once for each task, a function from one row to one output row.

    Rows travel in Arrow batches; only ``columns`` are read.
    """
    target = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = work()
        for batch in batches:
            rows = [function(*values) for values in zip(*(c.to_pylist() for c in batch.columns))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), target)], schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))
    return small_batches(df).select(*columns).mapInArrow(giving_back(run), schema)


def keep_rows(df: DataFrame, columns: list[str], work: Callable[[], Callable[..., bool]]) -> DataFrame:
    """Keeps the rows for which the function made by ``work()`` holds; all columns stay."""
    names = df.columns
    places = [names.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = work()
        for batch in batches:
            mask = [bool(function(*values)) for values in zip(*(batch.column(i).to_pylist() for i in places))]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return small_batches(df).mapInArrow(giving_back(run), df.schema)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once: inside a lambda a column expression would be
    evaluated again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Odd multipliers that mix 64-bit hashes.
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD))
_base = np.uint64(0x5851F42D4C957F2D)
_inverse = np.uint64(pow(int(_base), -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1, modulo 2^64."""
    out = np.full(max(1, n), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Spans:
    """Hashes of any spans of a sequence of numbers, by prefix sums of a polynomial modulo 2^64.

    Equal spans have equal hashes wherever they stand and whatever stands around them."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(_base, n), out=self.sums[1:])
        self.back = powers(_inverse, n + 1)

    def hashes(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[first]) * self.back[first] ^ (end - first).astype(np.uint64) * MIX[1]
        h = (h ^ h >> np.uint64(32)) * MIX[0]
        return (h ^ h >> np.uint64(29)) * MIX[4]


def split_words(texts: pa.Array, breaks: str, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts, index of each word's text). Null counts as empty; ``breaks`` is a
    regular expression (RE2) of what lies between words."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if lower:
        texts = pc.utf8_lower(texts)
    listed = pc.split_pattern_regex(texts, breaks)
    words, owner = listed.flatten(), pc.list_parent_indices(listed)
    kept = pc.not_equal(words, "")
    return words.filter(kept), owner.filter(kept).to_numpy(zero_copy_only=False)


def string_bounds(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_string array without nulls."""
    words = pa.concat_arrays([words])  # offsets from 0
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word: of its bytes in UTF-8."""
    data, at = string_bounds(words)
    first = at[0] if len(at) else 0
    return Spans(data[first : at[-1]]).hashes(at[:-1] - first, at[1:] - first)


def text_runs(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in runs whose texts have about ``most_bytes`` together (one row
    at least), so that work on whole runs needs bounded memory."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for a, z in zip(cuts, cuts[1:]):
            if z > a:
                yield batch.slice(a, z - a)
