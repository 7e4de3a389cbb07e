"""Conflict-constrained best-fit packing of texts into context windows.

Texts are cut into pieces of at most a window's length and dealt into packing groups by a hash of id and piece, so that
no source or duplicate cluster gathers in one group; a group holds about ``group_pieces`` pieces at any input size.
Within a group bins are ordered by residual room and carry bitmaps of their sources and duplicate clusters. Pieces come
longest first; the search begins at the tightest bin that has room and goes on through its successors until one
is compatible. A bin takes no two pieces of one duplicate cluster, and ``per_source`` pieces of a source at most.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eralith.llm._spark import written
from eralith.llm._text import Words, slices


def best_fit(lengths: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int) -> list[int]:
    """Bin of each piece, in the order given. Sources and clusters are small numbers: bits of a bin's bitmaps.

    A bin has per_source bitmaps of sources: the k-th holds those with k pieces or more.
    """
    order: list[tuple[int, int]] = []  # (residual, bin), ascending
    held: list[list[int]] = []  # bin -> [clusters, sources once, sources twice, ...]
    out = []
    for n, source, cluster in zip(lengths, sources, clusters, strict=True):
        s, c = 1 << source, 1 << cluster
        at = bisect_left(order, (n, -1))
        while at < len(order):
            bits = held[order[at][1]]
            if not (bits[0] & c or bits[-1] & s):
                break
            at += 1
        if at < len(order):
            room, b = order.pop(at)
        else:
            room, b = capacity, len(held)
            held.append([0] * (per_source + 1))
        bits = held[b]
        bits[0] |= c
        bits[next(k for k in range(1, per_source + 1) if not bits[k] & s)] |= s
        if room > n:
            insort(order, (room - n, b))
        out.append(b)
    return out


def best_fit_packing(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    capacity: int = 2048, per_source: int = 4, group_pieces: int = 4096,
) -> DataFrame:
    """(doc_id, piece, start, n_tokens, bin_group, bin, residual): where each piece of each text goes.

    Tokens are words; each piece has one more for its end mark (n_tokens counts it). Texts without words have one
    piece of the mark alone. The duplicate cluster is the exact text. A null source is a source of its own. Rows with
    equal ids are packed each; a row without an id is left out. bin numbers count within bin_group.
    """
    d = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        F.xxhash64(F.coalesce(F.col(source_col).cast("string"), F.lit("\0"))).alias("source"),
        F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("cluster"),
    ).where("doc_id is not null")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in slices(b.column(b.schema.get_field_index("text"))):
                n = np.diff(Words(t).first)
                pieces = np.maximum(-(-n // (capacity - 1)), 1)
                row = np.repeat(np.arange(t.n), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                size = np.minimum(n[row] - piece * (capacity - 1), capacity - 1) + 1
                take = pa.array(row + t.first)
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)).take(take) for c in ("doc_id", "source", "cluster")), *(pa.array(x.astype(np.int64)) for x in (piece, piece * (capacity - 1), size))], names=["doc_id", "source", "cluster", "piece", "start", "n_tokens"])

    pieces = d.mapInArrow(measure, "doc_id long, source long, cluster long, piece long, start long, n_tokens long")
    pieces = written(pieces.withColumn("serial", F.monotonically_increasing_id()))
    groups = max(1, round(pieces.count() / group_pieces))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        number = lambda c: pd.factorize(pdf[c])[0].tolist()
        pdf["bin"] = best_fit(pdf["n_tokens"].tolist(), number("source"), number("cluster"), capacity, per_source)
        pdf["residual"] = capacity - pdf.groupby("bin")["n_tokens"].transform("sum")
        return pdf[["doc_id", "piece", "start", "n_tokens", "bin_group", "bin", "residual"]]

    dealt = pieces.withColumn("bin_group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    # an id that stands in very many rows fills its group: such groups are dealt out anew by the written row's number
    large = dealt.groupBy("bin_group").agg(F.count("*").alias("n")).where(F.col("n") > 4 * group_pieces)
    if not large.isEmpty():
        part = F.pmod(F.xxhash64("serial"), F.ceil(F.col("n") / group_pieces)) + 1
        dealt = dealt.join(large, "bin_group", "left").withColumn("bin_group", F.col("bin_group") + groups * F.coalesce(part, F.lit(0)))
    return dealt.groupBy("bin_group").applyInPandas(pack, "doc_id long, piece long, start long, n_tokens long, bin_group long, bin long, residual long")


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Packing of documents into windows of 2,048 tokens."""
    return best_fit_packing(spark.read.parquet(f"{sf_dir}/documents.parquet"))
