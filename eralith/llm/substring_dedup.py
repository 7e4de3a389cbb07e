"""Substring dedup over words: difference-cover anchors, extended to whole windows.

Anchors are runs of ``anchor`` words that begin at positions whose remainder modulo ``period`` lies in a difference
cover. Whatever the offsets of two equal windows, some shift below ``period`` puts both at cover positions; so two
equal runs of ``anchor + period - 1`` words share an aligned anchor. Only where an anchor is shared between texts are
full windows (128-bit hashes) compared, which is the extension of the match to its exact ends.

Shuffled are anchors (six of 31 positions), then the windows around shared anchors, then removed positions: all
proportional to the input. What a text repeats within itself travels once, with all its places. Of equal texts the one with the least id speaks for all; a text of a window or more that
has an equal text with a smaller id goes as a whole. Groups are never collected: each is one sorted stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eralith.llm._spark import documents, id_filter, shared_runs, written
from eralith.llm._text import Words, covered, gathered, lists, slices, thinned, windows

#: Period and cover: every difference modulo 31 is a difference of two members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """(doc_id, text_hash, n_words, n_removed, kept_text, cut_text): words in windows that a smaller id has too are removed.

    Words are runs without ASCII white space; kept words are joined by one space. cut_text is the text as it was, line
    breaks and all, without the removed words and the white space behind them; null where none is removed. Windows are
    judged on the input. text_hash tells texts of one id apart. Null and empty texts: 0, 0, '', null. A row without id is left out. Rows with the same id do not remove from each
    other. Windows of fewer than 31 words would leave no room for an anchor: ValueError.
    """
    anchor = window - PERIOD + 1
    if anchor < 1:
        raise ValueError(f"window must be {PERIOD} words or more")
    d = documents(docs, id_col, text_col)
    spark = docs.sparkSession

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_cover = np.isin(np.arange(PERIOD), COVER)
        for b in batches:
            doc, sig = (np.asarray(b.column(c)) for c in ("doc", "sig"))
            for t in slices(b.column(b.schema.get_field_index("text"))):
                w = Words(t)
                long = np.diff(w.first) >= window
                if not long.any():
                    continue
                start, h = windows(w.hashes(), w.first, anchor)
                of = np.searchsorted(w.first, start, "right") - 1
                at = start - w.first[of]
                use = in_cover[at % PERIOD] & long[of]
                h, of, at = h[use].view(np.int64), of[use], at[use].astype(np.int32)
                order, first, n = gathered(h, of)
                of = of[order[first]] + t.first
                rows, key, known = thinned(h[order[first]], sig[of], doc[of])
                yield pa.record_batch([pa.array(key), sig[of[rows]], doc[of[rows]], lists(pa.array(at[order]), n).take(pa.array(rows)), pa.array(known)], names=["h", "sig", "doc", "at", "known"])

    # equal texts: all but those with the least id go as a whole, if they hold a window
    sigs = d.select("doc", "sig", F.xxhash64(F.lit(1), F.col("text")).alias("sig2"))
    equal = sigs.groupBy("sig", "sig2").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
    copies = written(sigs.join(equal, ["sig", "sig2"]).where("doc > least").select("doc", "sig", F.lit(True).alias("copy")).distinct())
    found = d.mapInArrow(anchors, "h long, sig long, doc long, at array<int>, known boolean")
    refs = shared_runs(found, ["h"], ["at"], "doc long, sig long, at array<int>", between_texts=True)
    refs = refs.join(copies, ["doc", "sig"], "left_anti")  # slices tell of copies too
    refs = written(refs.groupBy("doc", "sig").agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("at")))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, sig = (np.asarray(b.column(c)) for c in ("doc", "sig"))
            at = b.column(b.schema.get_field_index("at"))
            ends, flat = at.offsets.to_numpy(), np.asarray(at.values).astype(np.int64)
            for t in slices(b.column(b.schema.get_field_index("text"))):
                w = Words(t)
                n = np.diff(w.first)
                a = flat[ends[t.first] : ends[t.first + t.n]]
                of = np.repeat(np.arange(t.n), np.diff(ends[t.first : t.first + t.n + 1]))
                lo = np.maximum(a - (window - anchor), 0)
                hi = np.minimum(a + 1, n[of] - window + 1)
                ok = hi > lo
                lo, hi = lo[ok] + w.first[of[ok]], hi[ok] + w.first[of[ok]]
                start = np.flatnonzero(covered(lo, hi, len(w.start)))
                if not len(start):
                    continue
                of = np.searchsorted(w.first, start, "right") - 1
                local = (start - w.first[of]).astype(np.int32)
                h, h2 = (windows(w.hashes(which), np.array([0, len(w.start)]), window)[1][start].view(np.int64) for which in (0, 1))
                order, first, n = gathered(h, of)
                lead = order[first]
                of = of[lead] + t.first
                yield pa.record_batch([pa.array(h[lead]), pa.array(h2[lead]), sig[of], doc[of], lists(pa.array(local[order]), n)], names=["h", "h2", "sig", "doc", "at"])

    near = id_filter(refs, "doc")
    dense = (
        d.where(near(F.col("doc"))).join(refs, ["doc", "sig"]).select("doc", "sig", "text", "at")
        .mapInArrow(around, "h long, h2 long, sig long, doc long, at array<int>")
    )

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, least = (None, None), None
        for b in batches:
            if not b.num_rows:
                continue
            h, h2, doc = (np.asarray(b.column(c)) for c in ("h", "h2", "doc"))
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])
            new[0] = (h[0], h2[0]) != last
            at = np.flatnonzero(new)
            first = np.full(len(h), least if least is not None else 0, np.int64)
            if len(at):
                first[at[0] :] = np.repeat(doc[at], np.diff(np.append(at, len(h))))
            last, least = (h[-1], h2[-1]), first[-1]
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(doc > first)) for c in ("doc", "sig", "at")], names=["doc", "sig", "at"])

    removed = dense.repartition("h", "h2").sortWithinPartitions("h", "h2", "doc").mapInArrow(later, "doc long, sig long, at array<int>")
    removed = removed.groupBy("doc", "sig").agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("at"))
    known = written(removed.join(copies, ["doc", "sig"], "full"))
    touched = id_filter(known, "doc")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, sig = (b.column(b.schema.get_field_index(c)) for c in ("doc", "sig"))
            i = b.schema.get_field_index("at")
            at = pc.fill_null(b.column(i), pa.scalar([], pa.list_(pa.int32()))) if i >= 0 else None
            ends, flat = (at.offsets.to_numpy(), np.asarray(at.values).astype(np.int64)) if at is not None else (None, None)
            copy = np.asarray(pc.fill_null(b.column(b.schema.get_field_index("copy")), False)) if at is not None else None
            for t in slices(b.column(b.schema.get_field_index("text"))):
                n_words, n_removed, kept, cut = [], [], [], []
                w = Words(t) if at is not None else None
                for j, raw in enumerate(t.each()):
                    words = raw.split()
                    n, row, rest = len(words), t.first + j, None
                    if at is not None:
                        starts = flat[ends[row] : ends[row + 1]]
                        if copy[row] and n >= window:
                            words, rest = [], b""
                        elif len(starts):
                            gone = covered(starts, starts + window, n)
                            words = [words[k] for k in np.flatnonzero(~gone).tolist()]
                            rest = _without(raw, gone, *(x[w.first[j] : w.first[j + 1]] - t.offsets[j] for x in (w.start, w.end)))
                    cut.append(rest)
                    n_words.append(n)
                    n_removed.append(n - len(words))
                    kept.append(b" ".join(words))
                yield pa.record_batch([doc.slice(t.first, t.n), sig.slice(t.first, t.n), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), *(pa.array(x, pa.binary()).cast(pa.string()) for x in (kept, cut))], names=["doc_id", "text_hash", "n_words", "n_removed", "kept_text", "cut_text"])

    schema = "doc_id long, text_hash long, n_words long, n_removed long, kept_text string, cut_text string"
    plain = d.where(~touched(F.col("doc"))).select("doc", "sig", "text").mapInArrow(keep, schema)
    cut = d.where(touched(F.col("doc"))).join(known, ["doc", "sig"], "left").select("doc", "sig", "text", "at", "copy").mapInArrow(keep, schema)
    return plain.unionByName(cut)


def _without(raw: bytes, gone: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """raw without the words that are gone (start and end of every word) and the white space behind them."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]))).tolist()
    out, at = [], 0
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        out.append(raw[at : start[a]])
        at = start[b] if b < len(start) else end[-1]
    return b"".join([*out, raw[at:]])


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Digest of substring_dedup over documents, windows of 50 words."""
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
