"""Byte-level BPE encoding and decoding: speculate, verify, and merge exactly only where the guess fails.

New words of a slice are guessed together by greedy longest match. A sequence of tokens is the merge result exactly if
every adjacent pair on its own would stay apart, so the guess is verified by testing distinct adjacent pairs, all at
once: both tokens are taken apart along their merges, latest merge first, and the pair fails if tokens that
face each other across the seam would have merged before either was complete. Words with a failing pair, and only
they, are merged step by step. Encodings of words are kept in a dictionary of bounded size for each task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eralith.llm._text import slices

#: Fixed value: the published splitting pattern of this vocabulary family.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose encodings a task keeps.
KEPT_WORDS = 400_000


def byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in the vocabulary file: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens as bytes, and for each merged token its two parts and the rank of its merge."""

    def __init__(self, content: str):
        data = json.loads(content)
        letters = byte_letters()
        spell = lambda s: bytes(letters[c] for c in s)
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.ids = {spell(s): i for s, i in data["model"]["vocab"].items() if s not in self.special}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for s, i in self.ids.items():
            self.bytes[i] = s
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.longest = max(map(len, self.ids))
        self.left, self.right = np.full(size, -1), np.full(size, -1)
        self.rank = np.full(size, -1)  # -1: a single byte, never merged
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            a, b = (self.ids[spell(x)] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            whole = self.ids[self.bytes[a] + self.bytes[b]]
            self.merges[a, b] = (rank, whole)
            if self.rank[whole] < 0:
                self.left[whole], self.right[whole], self.rank[whole] = a, b, rank
        keys = np.array([a * size + b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.array([r for r, _ in self.merges.values()], np.int64)[order]
        self.pattern = regex.compile(PATTERN)
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of a and b; a huge number where there is none."""
        key = a * len(self.bytes) + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], np.iinfo(np.int64).max)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens stays apart when its bytes are merged.

        Time runs backwards: facing tokens x | y exist from their own merges on until the seam side's next merge at
        time t, which is the least rank of the two that were taken apart last. They would merge at rank r if r comes
        before t, or at t itself if the seam pair lies left of the merge that it competes with.
        """
        a, b = a.copy(), b.copy()
        n = len(a)
        ok = np.ones(n, bool)
        # the pair must merge at a rank below until; equal ranks go to the leftmost place, which is the seam's
        # pair if the other merge lies in the right token
        until = np.full(n, np.iinfo(np.int64).max)
        ties = np.zeros(n, bool)
        live = np.arange(n)
        while len(live):
            x, y = a[live], b[live]
            r = self.pair_rank(x, y)
            u = until[live]
            bad = (r < u) | ((r == u) & ties[live] & (r < np.iinfo(np.int64).max))
            ok[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~bad & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[go], x[go], y[go], rx[go], ry[go]
            # the later merge is undone first; of equal ranks the right one happened later
            left = rx > ry
            a[live[left]] = self.right[x[left]]
            b[live[~left]] = self.left[y[~left]]
            until[live] = np.where(left, rx, ry)
            ties[live] = ~left
        return ok

    def greedy(self, word: bytes) -> list[int]:
        ids, out, i, n, longest = self.ids, [], 0, len(word), self.longest
        while i < n:
            for j in range(min(n, i + longest), i, -1):
                t = ids.get(word[i:j])
                if t is not None:
                    out.append(t)
                    i = j
                    break
        return out

    def exact(self, word: bytes) -> list[int]:
        """Merging by rank, leftmost first, over a linked list with a heap: n log n for long words."""
        from heapq import heapify, heappop, heappush

        t = [self.ids[word[i : i + 1]] for i in range(len(word))]
        n = len(t)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = self.merges
        heap = [(m[0], i, t[i], t[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((t[i], t[i + 1])))]
        heapify(heap)
        while heap:
            _, i, x, y, whole = heappop(heap)
            j = after[i]
            if t[i] != x or j >= n or t[j] != y:
                continue
            t[i], t[j] = whole, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((whole, t[k])):
                    heappush(heap, (m[0], i, whole, t[k], m[1]))
            h = before[i]
            if h >= 0 and (m := merges.get((t[h], whole))):
                heappush(heap, (m[0], h, t[h], whole, m[1]))
        return [x for x in t if x >= 0]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit integers."""
        guesses = [self.greedy(w) for w in words]
        lengths = np.fromiter(map(len, guesses), np.int64, len(guesses))
        flat = np.fromiter((t for g in guesses for t in g), np.int64, int(lengths.sum()))
        of = np.repeat(np.arange(len(words)), lengths)
        inner = np.flatnonzero(of[1:] == of[:-1])
        key, back = np.unique(flat[inner] * len(self.bytes) + flat[inner + 1], return_inverse=True)
        ok = self.compatible(key // len(self.bytes), key % len(self.bytes))[back]
        failed = np.unique(of[inner[~ok]])
        out = [np.array(g, "<u4").tobytes() for g in guesses]
        for i in failed.tolist():
            out[i] = np.array(self.exact(words[i]), "<u4").tobytes()
        return out


@lru_cache(maxsize=2)
def _vocabulary(name: str) -> Vocabulary:
    with open(SparkFiles.get(name), encoding="utf-8") as f:
        return Vocabulary(f.read())


def bpe_round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids as little-endian 32-bit integers and the text decoded from them.

    vocabulary: path of a byte-level BPE file on the driver; Spark ships it to the executors. Strings of special
    tokens in a text become those tokens; no other tokens are added. Null and empty texts: no ids and ''. A row
    without an id is left out; rows that repeat are encoded each.
    """
    import os

    spark = docs.sparkSession
    spark.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(name)
        known: dict[str, bytes] = {}
        split, special = v.pattern.findall, v.special_pattern
        marks = {s: np.array([i], "<u4").tobytes() for s, i in v.special.items()}
        for b in batches:
            ids = b.column(0)
            for t in slices(b.column(1)):
                pieces: list[list[str]] = []
                for raw in t.each():
                    text = raw.decode()
                    if special is not None and any(s in text for s in marks):
                        pieces.append([p for part in special.split(text) for p in ([part] if part in marks else split(part))])
                    else:
                        pieces.append(split(text))
                if len(known) > KEPT_WORDS:
                    known = {}
                new = list({w for p in pieces for w in p}.difference(known, marks))
                known.update(zip(new, v.encode_words([w.encode() for w in new]), strict=True))
                known.update(marks)
                coded = [b"".join(map(known.__getitem__, p)) for p in pieces]
                decoded = [b"".join(map(v.bytes.__getitem__, np.frombuffer(c, "<u4").tolist())).decode(errors="replace") for c in coded]
                yield pa.record_batch([ids.slice(t.first, t.n), pa.array([len(c) // 4 for c in coded], pa.int64()), pa.array(coded, pa.binary()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return d.mapInArrow(encode, "doc_id long, n_tokens long, ids binary, decoded string")


def op5_bpe(spark, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Digest of bpe_round_trip over documents."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    out = bpe_round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
