"""Packing: bounded-space best fit, online in each partition, then a merge of leftovers.

A document's ids that fill whole sequences become sequences of their own; the rest goes
into the open window that it fits best. A task keeps ``OPEN`` windows: when none fits, the
fullest is emitted and a new one opened. Windows left open at the end of a task are merged
in groups of tasks, again by best fit, so no group grows with the input.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import giving_back, read, reliable_checkpoint, small_batches

LENGTH = 2048
OPEN = 128
#: Tasks whose leftovers are merged together.
GROUP = 16
END_ID = 1
#: Fixed: how the vocabulary's texts are cut before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs this long are left to the tokenizer library, whose cost doesn't grow with their square.
LONG_RUN = re.compile(r"\S{2000}|\s{2000}")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def follows_merges(data: dict) -> bool:
    """Whether a tokenizer file's ids are in the order of its merges: 256 letters first, then what
    each merge makes, so that ids can stand for merge ranks."""
    vocabulary, special = data["model"]["vocab"], {t["content"] for t in data["added_tokens"]}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
    made = [vocabulary.get(a + b, -1) for a, b in pairs]
    letters = [i for t, i in vocabulary.items() if len(t) == 1 and t not in special]
    plain = data["model"].get("type") == "BPE" and not data["model"].get("ignore_merges") and not data["model"].get("end_of_word_suffix")
    return plain and len(letters) == 256 and all(x < y for x, y in zip([max(letters), *made], made)) and len(letters) + len(made) == len(vocabulary.keys() - special)


def tokenizer(path: str):
    """text -> ids, equal to the tokenizer file's own. The same vocabulary drives a faster
    encoder if the file holds a byte-level BPE whose ids follow its merges; otherwise, and for
    texts with special tokens or very long runs, the tokenizer library does it."""
    import tiktoken
    from tokenizers import Tokenizer

    from .bpe import byte_letters

    slow = Tokenizer.from_file(path)
    slow.no_truncation()
    slow.no_padding()
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    by_library = lambda text: slow.encode(text, add_special_tokens=False).ids
    if not follows_merges(data):
        return by_library
    special = {t["content"]: t["id"] for t in data["added_tokens"]}
    letters = {c: b for b, c in enumerate(byte_letters())}
    ranks = {bytes(letters[c] for c in t): i for t, i in data["model"]["vocab"].items() if t not in special}
    fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> list[int]:
        if not text:
            return []
        if any(s in text for s in special) or (len(text) >= 2000 and LONG_RUN.search(text)):
            return by_library(text)
        return fast.encode_ordinary(text)

    return encode


class Windows:
    """Open windows by free space; ``place`` says where a piece goes and what that closes."""

    def __init__(self, most: int, length: int = LENGTH):
        self.most, self.length = most, length
        self.free: list[tuple[int, int]] = []  # (free space, window), ascending
        self.next = 0

    def place(self, size: int) -> tuple[int, int, int | None]:
        """(window, offset in it, window closed to make room)."""
        closed = None
        i = bisect_left(self.free, (size, -1))
        if i < len(self.free):
            space, window = self.free.pop(i)
        else:
            if len(self.free) >= self.most:
                closed = self.free.pop(0)[1]
            space, window = self.length, self.next
            self.next += 1
        if space > size:
            insort(self.free, (space - size, window))
        return window, self.length - space, closed


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, window long, offset long"


def first_pass(docs: DataFrame, path: str, open_windows: int = OPEN, length: int = LENGTH) -> DataFrame:
    """All pieces, with the task and the window they lie in. Window < 0: left open."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode, windows = tokenizer(path), Windows(open_windows, length)
        task = TaskContext.get().partitionId()
        pending: dict[int, list[tuple]] = {}
        out: list[tuple] = []
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "window", "offset"]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.array([*encode(text or ""), END_ID], "<u4")
                n = len(ids)
                whole = n - n % length
                for at in range(0, whole, length):
                    window = windows.next
                    windows.next += 1
                    out.append((doc_id, at, length, zlib.crc32(ids[at : at + length].tobytes()), n, task, window, 0))
                if whole < n:
                    window, offset, closed = windows.place(n - whole)
                    if closed is not None:
                        out += pending.pop(closed)
                    pending.setdefault(window, []).append((doc_id, whole, n - whole, zlib.crc32(ids[whole:].tobytes()), n, task, window, offset))
            for window in pending.keys() - {w for _, w in windows.free}:  # full
                out += pending.pop(window)
            if out:
                yield batch_of(out)
                out = []
        left = [(*row[:6], -1 - row[6], row[7]) for rows in pending.values() for row in rows]
        if left:
            yield batch_of(left)

    return small_batches(docs).select("doc_id", "text").mapInArrow(giving_back(run), PIECES)


def merge_left(sizes: DataFrame, group: int = GROUP, length: int = LENGTH) -> DataFrame:
    """Open windows (task, window, size) merged in groups of tasks by best fit, largest first."""

    def run(key, frame):
        import pandas as pd

        windows = Windows(len(frame) + 1, length)
        frame = frame.sort_values(["size", "task", "window"], ascending=[False, True, True])
        placed = [windows.place(int(s)) for s in frame["size"]]
        return pd.DataFrame({"task": frame["task"].values, "window": frame["window"].values, "bin": [p[0] for p in placed], "base": [p[1] for p in placed]})

    return sizes.groupBy(F.floor(F.col("task") / group).alias("g")).applyInPandas(run, "task long, window long, bin long, base long")


def pack(docs: DataFrame, path: str | None = None, open_windows: int = OPEN, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """One row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.

    Null and empty texts have the end id only: one piece of length 1. Null doc_ids and
    repeated rows are packed like others; no documents give no pieces. The first pass is
    checkpointed, because both kinds of windows must come from the same run of it.
    ``path``: the tokenizer file, present on every executor.
    """
    pieces = reliable_checkpoint(first_pass(docs, path or default_path(), open_windows, length))
    left = pieces.where("window < 0")
    merged = merge_left(left.groupBy("task", "window").agg(F.sum("length").alias("size")), group, length)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    closed = pieces.where("window >= 0").select(*columns, (F.shiftleft(F.col("task"), 32) + F.col("window")).alias("sequence_id"), "offset")
    opened = left.join(merged, ["task", "window"]).select(
        *columns,
        # groups of tasks number their sequences from the top half of the ids
        (F.lit(1 << 62) + F.shiftleft(F.floor(F.col("task") / group).cast("long"), 32) + F.col("bin")).alias("sequence_id"),
        (F.col("base") + F.col("offset")).alias("offset"),
    )
    return closed.unionByName(opened)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
