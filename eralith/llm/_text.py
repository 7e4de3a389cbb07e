"""Vectorised text helpers that run inside Arrow tasks: byte slices, words, rolling hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SLICE = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_rng = np.random.default_rng(20240229)
_BYTE_VALUES = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_C1, _C2, _C3 = (np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D))

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
LOWER_BYTES = LOWER.tobytes()


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, grown on demand."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, _SLICE + 1)
            up, down = np.full(size, _BASE), np.full(size, _INVERSE)
            up[0] = down[0] = 1
            cls.up, cls.down = np.cumprod(up), np.cumprod(down)
        return cls.up[:n], cls.down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads the bits of 64-bit hashes."""
    x = x ^ (x >> np.uint64(32))
    x *= _C1
    x ^= x >> np.uint64(29)
    x *= _C2
    x ^= x >> np.uint64(32)
    return x


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(a * _C3 + mix(b + _BASE))


class Rolling:
    """Prefix sums of value * base^position: the hash of any range in constant time."""

    def __init__(self, values: np.ndarray):
        up, self.down = _Powers.of(len(values) + 1)
        self.sums = np.empty(len(values) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def rolling_bytes(data: np.ndarray, which: int = 0) -> Rolling:
    return Rolling(_BYTE_VALUES[which][data])


class Texts:
    """Consecutive texts of a batch: rows first..last, their bytes and the byte offsets of each."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets
        self.n = len(offsets) - 1

    def raw(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def each(self) -> Iterator[bytes]:
        whole, at = self.data.tobytes(), self.offsets.tolist()
        return (whole[a:b] for a, b in zip(at, at[1:], strict=False))


def slices(column: pa.Array | pa.ChunkedArray, limit: int = _SLICE) -> Iterator[Texts]:
    """Runs of whole texts of about limit bytes (a longer text stands alone), so that work arrays stay small."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        to = min(to, len(column))
        yield Texts(row, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row])
        row = to


class Words:
    """Words of some texts. first[i]..first[i+1] are those of text i; hashes are made on demand."""

    def __init__(self, texts: Texts, lower: bool = False, space: np.ndarray = IS_SPACE):
        data = LOWER[texts.data] if lower else texts.data
        self.texts, self.data = texts, data
        n, inside = len(data), ~space[data]
        begins = np.zeros(n + 1, bool)
        begins[texts.offsets] = True
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | begins[:-1]))
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | begins[1:])) + 1
        self.first = np.searchsorted(self.start, texts.offsets)
        self.inside = inside

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts.n), np.diff(self.first))

    def hashes(self, which: int = 0) -> np.ndarray:
        return rolling_bytes(self.data, which).ranges(self.start, self.end)


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of all runs of k items that stay within one text."""
    lengths = np.maximum(np.diff(first) - k + 1, 0)
    start = spread(first[:-1], lengths)
    return start, Rolling(hashes).ranges(start, start + k)


def spread(start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... lengths[0] of them, then those of start[1], ..."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(start - (ends - lengths), lengths)


def covered(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in one of the ranges."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, start, 1)
    np.add.at(depth, end, -1)
    return np.cumsum(depth[:-1]) > 0


def lists(flat: pa.Array, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), flat)


def thinned(key: np.ndarray, sig: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a slice of texts need send of its keys to find those that several texts have: (rows, keys to deal by, known).

    Of equal texts (sig) the least doc stays. Where a key has more than two texts in the slice, two go on to tell others; that
    it is shared is known of the rest, which are dealt out by keys of their own. So a key that stands in every text sends two
    rows a slice to its one task.
    """
    order = np.lexsort((doc, sig, key))
    k, s = key[order], sig[order]
    new = np.ones(len(order), bool)
    new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
    rows = order[new]
    k = key[rows]
    head = np.ones(len(rows), bool)
    head[1:] = k[1:] != k[:-1]
    begin = np.flatnonzero(head)
    known = np.arange(len(rows)) - np.repeat(begin, np.diff(np.append(begin, len(rows)))) >= 2
    own = mix(k.view(np.uint64) ^ mix(doc[rows].view(np.uint64))).view(np.int64)
    return rows, np.where(known, own, k), known


def gathered(key: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal keys of one text (of) brought together: (order, first place in order, number) of each group.

    What a text repeats, however often, then goes through a shuffle as one row.
    """
    order = np.lexsort((key, of))
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (of[order][1:] != of[order][:-1])
    first = np.flatnonzero(new)
    return order, first, np.diff(np.append(first, len(order)))
