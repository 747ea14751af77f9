"""BPE encoding and decoding with a transducer lexicon.

The frequent words of the corpus are compiled, with the ids of their tokens, into a
minimal acyclic transducer: states with equal right languages are shared, and the outputs
along a path add up to the word's number in a table of ids. Executors map it into memory.
Words outside it are merged exactly, by the lowest merge rank first.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import re
import struct
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterator

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import giving_back, map_rows, read, reliable_checkpoint, small_batches

#: Fixed: how the vocabulary's texts are cut into words once normalised.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: The same cut for texts of the first 256 characters, for the faster standard library.
_first = [chr(i) for i in range(256)]
_letters, _numbers, _blanks = ("".join(re.escape(c) for c in _first if regex.match(p, c)) for p in (r"\p{L}", r"\p{N}", r"\s"))
WORD_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_letters}]+|[{_numbers}]|[^{_blanks}{_letters}{_numbers}]+")
END = "</w>"
#: Words in the lexicon, and candidates that a task keeps while it counts.
LEXICON_WORDS = 30_000
COUNTED = 200_000
#: Steps of the histogram of counts for a doubling of the count.
STEPS = 16


def byte_letters() -> list[str]:
    """The printable character for each byte: itself where printable, else the next free one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = [], 256
    for b in range(256):
        if b in shown:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


class Vocabulary:
    """A BPE vocabulary with word ends, read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        self.ids: dict[str, int] = data["model"]["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.letters = byte_letters()

    def merge(self, word: str) -> list[str]:
        """Tokens of a word: of all neighbours the pair of lowest rank merges, leftmost first."""
        parts = [self.letters[b] for b in word.encode("utf-8")]
        parts[-1] += END
        ranks = self.ranks
        if len(parts) > 200:
            return self.merge_long(parts)
        none = len(ranks)
        near = [ranks.get(p, none) for p in zip(parts, parts[1:])]  # rank of each part with the next
        while near:
            best = min(near)
            if best == none:
                break
            at = near.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del near[at]
            if at:
                near[at - 1] = ranks.get((parts[at - 1], parts[at]), none)
            if at < len(near):
                near[at] = ranks.get((parts[at], parts[at + 1]), none)
        return parts

    def merge_long(self, parts: list[str]) -> list[str]:
        """The same result by a heap over linked neighbours, for very long words."""
        import heapq

        n, ranks = len(parts), self.ranks
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i] = a + b
            alive[j] = False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n and (r := ranks.get((parts[x], parts[after[x]]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[after[x]]))
        return [p for p, on in zip(parts, alive) if on]


class Assigned:
    """Tells texts whose characters this Python's Unicode all assigns: libraries disagree on
    whether an unassigned character is a letter."""

    def __init__(self):
        self.known: set[str] = set()

    def __call__(self, text: str) -> bool:
        new = set(text) - self.known
        if new:
            if any(unicodedata.category(c) == "Cn" for c in new):
                return False
            self.known |= new
        return True


def normalized(text: str) -> str:
    """NFC and lower case, each character for itself (no word-final sigma)."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def words_of(text: str) -> list[str]:
    """The words of a text without special tokens, normalised."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return WORD.findall(normalized(text))
    return WORD_LATIN.findall(text.lower())  # such texts are in normal form


def compile_lexicon(words: dict[str, list[int]]) -> bytes:
    """The transducer as bytes: header, states, labels, targets, outputs, ids.

    Words are added in byte order to a minimal automaton (each finished state is replaced
    by an equal one that is registered); then each edge gets the number of words that
    come before it in its state, so that the sum along a path is the word's number.
    """
    keyed = sorted((w.encode("utf-8"), ids) for w, ids in words.items())
    edges: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path: list[int] = []  # states along the last word

    def shared(state: int) -> int:
        key = (final[state], tuple(sorted(edges[state].items())))
        return register.setdefault(key, state)

    last = b""
    path = [0]
    for word, _ in keyed:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        for i in range(len(last), common, -1):
            edges[path[i - 1]][last[i - 1]] = shared(path[i])
        path = path[: common + 1]
        for b in word[common:]:
            edges.append({})
            final.append(False)
            edges[path[-1]][b] = len(edges) - 1
            path.append(len(edges) - 1)
        final[path[-1]] = True
        last = word
    for i in range(len(last), 0, -1):
        edges[path[i - 1]][last[i - 1]] = shared(path[i])
    order, number, stack = [], {}, [0]
    while stack:
        s = stack.pop()
        if s not in number:
            number[s] = len(order)
            order.append(s)
            stack += edges[s].values()
    below: dict[int, int] = {}

    def words_below(top: int) -> int:
        stack = [top]
        while stack:
            s = stack[-1]
            missing = [t for t in edges[s].values() if t not in below]
            if missing:
                stack += missing
            else:
                below[s] = final[s] + sum(below[t] for t in edges[s].values())
                stack.pop()
        return below[top]

    words_below(0)
    first, labels, targets, outputs, ends = [], bytearray(), [], [], bytearray()
    for s in order:
        first.append(len(labels))
        ends.append(final[s])
        seen = int(final[s])
        for b, t in sorted(edges[s].items()):
            labels.append(b)
            targets.append(number[t])
            outputs.append(seen)
            seen += below[t]
    first.append(len(labels))
    flat = [i for _, ids in keyed for i in ids]
    offsets = [0]
    for _, ids in keyed:
        offsets.append(offsets[-1] + len(ids))
    head = struct.pack("<5I", len(order), len(labels), len(keyed), len(flat), 0)
    pad = lambda b: bytes(b) + b"\0" * (-len(b) % 4)
    ints = lambda xs: struct.pack(f"<{len(xs)}I", *xs)
    return head + ints(first) + ints(targets) + ints(outputs) + ints(offsets) + ints(flat) + pad(ends) + pad(labels)


class Lexicon:
    """A compiled lexicon, mapped into memory from an unnamed file of this process: a copy of
    what was broadcast, in the worker's own folder and gone with it, that nobody else reads."""

    def __init__(self, data: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        states, edges, words, ids, _ = struct.unpack_from("<5I", self.map)
        view, at = memoryview(self.map), 20

        def ints(n: int):
            nonlocal at
            part = view[at : at + 4 * n].cast("I")
            at += 4 * n
            return part

        self.first, self.targets, self.outputs, self.offsets, self.ids = ints(states + 1), ints(edges), ints(edges), ints(words + 1), ints(ids)
        self.ends = view[at : at + states]
        self.labels_at = at + states + (-states % 4)

    def get(self, word: str) -> list[int] | None:
        """Ids of the word's tokens, or None if the lexicon doesn't have it."""
        state = number = 0
        base, find = self.labels_at, self.map.find
        for b in word.encode("utf-8"):
            a, z = self.first[state], self.first[state + 1]
            i = find(b.to_bytes(), base + a, base + z)
            if i < 0:
                return None
            i -= base
            number += self.outputs[i]
            state = self.targets[i]
        if not self.ends[state]:
            return None
        return self.ids[self.offsets[number] : self.offsets[number + 1]].tolist()


def frequent_words(docs: DataFrame, keep: int = LEXICON_WORDS) -> list[str]:
    """About the ``keep`` words of most occurrences, counted over all texts.

    A task keeps the counts of at most ``2 * COUNTED`` words: when there are more, the
    rarer half goes. Words of more than 200 characters are left to merging. The least count is
    found from a histogram of counts (STEPS to a doubling), so the driver gets at most ``keep``
    words whatever the number of partitions. Which words are in the lexicon never changes a
    result.
    """

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    words.update(words_of(text))
                    if len(words) > 2 * COUNTED:
                        words = Counter(dict(words.most_common(COUNTED)))
        top = [(w, n) for w, n in words.most_common(2 * keep) if len(w) <= 200]
        yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    counted = small_batches(docs).select("text").mapInArrow(giving_back(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = reliable_checkpoint(counted.withColumn("step", F.floor(F.log2(F.col("n").cast("double")) * STEPS + 1e-9)))
    least, total = None, 0
    for step, words in sorted(((r["step"], r["count"]) for r in counted.groupBy("step").count().collect()), reverse=True):
        total += words
        if total > keep:
            break
        least = step
    return sorted(r["word"] for r in counted.where(F.col("step") >= least).select("word").collect()) if least is not None else []


class Words(dict):
    """Word to (ids as little-endian unsigned 32-bit integers, tokens with blanks between).

    Filled on demand; when it holds ``bound`` words they become the older generation, from
    which words come back when met again."""

    def __init__(self, code, bound: int):
        super().__init__()
        self.code, self.bound, self.older = code, bound, {}

    def __missing__(self, word: str) -> tuple[bytes, str]:
        out = self.older.get(word)
        if out is None:
            out = self.code(word)
        if len(word) <= 200:
            if len(self) >= self.bound:
                self.older = dict(self)
                self.clear()
            self[word] = out
        return out


class Coder:
    """Encodes and decodes whole texts; remembers words already seen (bounded)."""

    def __init__(self, path: str, lexicon: bytes | None = None, bound: int = 250_000):
        self.vocabulary = Vocabulary(path)
        self.names = {i: t for t, i in self.vocabulary.ids.items()} | {i: t for t, i in self.vocabulary.special.items()}
        self.lexicon = Lexicon(lexicon) if lexicon else None
        self.words = Words(self.word, bound)
        self.path, self.library, self.assigned = path, None, Assigned()
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.vocabulary.special, key=len, reverse=True)))) if self.vocabulary.special else None

    def word(self, word: str) -> tuple[bytes, str]:
        """Ids and tokens of a word: from the lexicon, else by merging."""
        ids = self.lexicon.get(word) if self.lexicon and len(word) <= 200 else None
        if ids is not None:
            return self.packed(ids)
        of = self.vocabulary.ids
        return self.packed([of[t] for t in self.vocabulary.merge(word)])

    def packed(self, ids: list[int]) -> tuple[bytes, str]:
        """The ids as bytes, and what they decode to."""
        return struct.pack(f"<{len(ids)}I", *ids), self.decode(ids)

    def by_library(self, text: str) -> list[int]:
        """Ids of a text with unassigned characters, by the tokenizer library itself."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
        return self.library.encode(text, add_special_tokens=False).ids

    def pieces(self, text: str) -> list[tuple[bytes, str]]:
        """What ``word`` gives, for each word of the text and each special token in it."""
        if not text.isascii() and not self.assigned(text):
            return [self.packed(self.by_library(text))]
        words = self.words
        if not self.split or "<|" not in text:
            return [words[w] for w in words_of(text)]
        out, at = [], 0
        for m in self.split.finditer(text):
            out += [words[w] for w in words_of(text[at : m.start()])]
            out.append(self.packed([self.vocabulary.special[m.group()]]))
            at = m.end()
        return out + [words[w] for w in words_of(text[at:])]

    def encode(self, text: str | None) -> list[int]:
        data = b"".join([p[0] for p in self.pieces(text or "")])
        return list(struct.unpack(f"<{len(data) // 4}I", data))

    def decode(self, ids: list[int]) -> str:
        """Tokens with blanks between, special ones too (the vocabulary has no decoder)."""
        return " ".join([self.names[i] for i in ids if i in self.names])

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """How many ids, sha256 of the ids, sha256 of the decoded text."""
        parts = self.pieces(text or "")
        data = b"".join([p[0] for p in parts])
        decoded = " ".join([p[1] for p in parts])
        return len(data) // 4, hashlib.sha256(data).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest()


_coder: tuple | None = None


def coder(path: str, lexicon: bytes) -> Coder:
    """The coder of this process: the next task of a worker goes on with the words seen."""
    global _coder
    key = (path, hash(lexicon))
    if _coder is None or _coder[0] != key:
        _coder = (key, Coder(path, lexicon))
    return _coder[1]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def build_lexicon(docs: DataFrame, path: str, keep: int = LEXICON_WORDS) -> bytes:
    vocabulary = Vocabulary(path)
    return compile_lexicon({w: [vocabulary.ids[t] for t in vocabulary.merge(w)] for w in frequent_words(docs, keep)})


def encode(docs: DataFrame, path: str | None = None, keep: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, n_tokens and digests of ids and of the decoded text: one row for each row.

    Null texts count as empty: no ids. Null doc_ids and repeated rows keep their rows;
    other columns are ignored. ``path``: the tokenizer file, present on every executor.
    """
    path = path or default_path()
    shared = docs.sparkSession.sparkContext.broadcast(build_lexicon(docs, path, keep))

    def work():
        digests = coder(path, shared.value).digests
        return lambda doc_id, text: (doc_id, *digests(text))

    return map_rows(docs, ["doc_id", "text"], work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"))
