"""Fill-in-the-middle transformation over a sparse index of checkpoints.

While the units of a text are counted, their byte and code-point offsets are recorded once in ``every`` units. A cut, which is
known only when the count is, is found by binary search among the checkpoints and a scan of at most ``every`` units from there.
Texts are counted in stretches of 64 KB, so that besides a text and its output a task holds only the checkpoints. The
transformation looks at one text at a time: there is no shuffle, and no text is heavier than its own length.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eralith.llm._spark import text_hash
from eralith.llm._text import IS_SPACE, slices

#: Bytes that are counted at a time.
STRETCH = 1 << 16
MARKERS = ("<P>", "<S>", "<M>")


def _chars(data: np.ndarray, before: int) -> np.ndarray:
    return (data & 0xC0) != 0x80


def _words(data: np.ndarray, before: int) -> np.ndarray:
    space = IS_SPACE[data]
    behind = np.empty(len(data), bool)
    behind[:1], behind[1:] = IS_SPACE[before], space[:-1]
    return space & ~behind


def _lines(data: np.ndarray, before: int) -> np.ndarray:
    begins = np.empty(len(data), bool)
    begins[:1], begins[1:] = before == 10, data[:-1] == 10
    return begins


#: unit -> where units begin in some bytes, given the byte before them: code points; words, each with the white space before
#: it (white space at a text's end is a unit of its own); lines with their line break. A text's first byte always begins one.
UNITS: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {"char": _chars, "word": _words, "line": _lines}


class Checkpoints:
    """Counts the units and code points of a text and answers where a unit begins."""

    def __init__(self, data: np.ndarray, unit: str = "char", every: int = 512):
        self.data, self.begins = data, UNITS[unit]
        self.units = self.points = 0
        #: Number, byte offset and code-point offset of every ``every``-th unit.
        self.number: list[int] = []
        self.byte: list[int] = []
        self.point: list[int] = []
        for at in range(0, len(data), STRETCH):
            starts, lead = self._starts(at, at + STRETCH)
            first = -self.units % every
            for i in range(first, len(starts), every):
                self.number.append(self.units + i)
                self.byte.append(at + int(starts[i]))
                self.point.append(self.points + int(np.searchsorted(lead, starts[i])))
            self.units += len(starts)
            self.points += len(lead)

    def _starts(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Where units and code points begin in bytes a to b, counted from a."""
        piece = self.data[a:b]
        begins = self.begins(piece, int(self.data[a - 1]) if a else 0)
        if a == 0:
            begins[:1] = True
        return np.flatnonzero(begins), np.flatnonzero(_chars(piece, 0))

    def locate(self, unit: int) -> tuple[int, int]:
        """(byte, code point) at which a unit begins; the text's end for the number of its units."""
        if unit >= self.units:
            return len(self.data), self.points
        i = bisect_right(self.number, unit) - 1
        left, at, point, stretch = unit - self.number[i], self.byte[i], self.point[i], 4096
        while True:
            starts, lead = self._starts(at, at + stretch)
            if left < len(starts):  # the scan begins at a unit's first byte, so the stretch's first start is that unit
                return at + int(starts[left]), point + int(np.searchsorted(lead, starts[left]))
            left, at, point = left - len(starts), at + stretch, point + len(lead)


def draws(key: str) -> list[int]:
    """Four 32-bit numbers that a key decides."""
    digest = hashlib.sha256(key.encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char", markers: tuple[str, str, str] = MARKERS,
    plain_percent: int = 10, suffix_first_percent: int = 20, seed: int = 1, every: int = 512,
) -> DataFrame:
    """(doc_id, text_hash, n, form, prefix_chars, middle_chars, output): one row per row of docs that has an id.

    Two cuts, which seed and id decide, part a text of n units into prefix, middle and suffix; they may be empty. form psm:
    marker P, prefix, marker S, suffix, marker M, middle; spm: marker S, suffix, marker P, prefix, marker M, middle; plain: the
    text as it is, without lengths. Plain are empty and null texts, texts that hold a marker, as no output could be told apart
    then, and plain_percent of the others; of the rest suffix_first_percent are spm. Lengths are in code points, whatever
    the unit. Repeated ids are cut at the same draws; a row without an id is left out.
    """
    p, s, m = (x.encode() for x in markers)
    if len({p, s, m}) < 3 or any(x.startswith(y[k:]) for x in (p, s, m) for y in (p, s, m) for k in range(1, len(y))) or not all((p, s, m)):
        raise ValueError("markers must be different, not empty, and none may begin as one ends")
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")
    d = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]

    def cut(raw: bytes, doc: int) -> tuple[int, str, int | None, int | None, bytes]:
        index = Checkpoints(np.frombuffer(raw, np.uint8), unit, every)
        n = index.units
        h1, h2, h3, h4 = draws(f"{seed}:{doc}")
        if not raw or p in raw or s in raw or m in raw or h3 % 100 >= 100 - plain_percent:
            return n, "plain", None, None, raw
        first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
        (a, a_point), (b, b_point) = index.locate(first), index.locate(second)
        if h4 % 100 < suffix_first_percent:
            return n, "spm", a_point, b_point - a_point, b"".join((s, raw[b:], p, raw[:a], m, raw[a:b]))
        return n, "psm", a_point, b_point - a_point, b"".join((p, raw[:a], s, raw[b:], m, raw[a:b]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for t in slices(batch.column(2)):
                out = zip(*(cut(raw, doc) for raw, doc in zip(t.each(), ids[t.first : t.first + t.n], strict=True)), strict=True)
                made = [pa.array(x, kind) for x, kind in zip(out, types, strict=True)]
                made[-1] = made[-1].cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(t.first, t.n) for i in (0, 1)), *made], names=["doc_id", "text_hash", *names])

    return d.mapInArrow(work, "doc_id long, text_hash long, n long, form string, prefix_chars long, middle_chars long, output string")


def rebuilt(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output of fill_in_middle was made of, from the output and its form alone."""
    part = F.split(output, "|".join(map(re.escape, markers)), -1)  # the empty piece before the first marker, then the three parts
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1]))


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Digests of the outputs of fill_in_middle over documents, and of the texts rebuilt from them."""
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"), digest(rebuilt(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
