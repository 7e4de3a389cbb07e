"""Repeated byte strings by a depth-limited radix sort of suffixes, most significant digit first.

Suffixes are ordered only through the threshold (400 bytes): equal groups after that depth are the repeated strings. A pass
deals suffixes out by their next digit, and groups of one drop out.

The first pass deals out whole stretches of suffixes at once, by the bytes that all of a stretch share. Content-defined points
(those whose next 16 bytes hash below 1/48) part a text; suffixes are sorted into stretches by how far before the next point
they begin, and every suffix of a stretch holds the same number of bytes from that point on: its first digit, which travels
under a 64-bit name. A stretch's second digit is all its bytes, from its first suffix to the end of the last one's string. Two
that are alike in both are settled: each suffix is repeated through the threshold. Where stretches share the first digit but
not the second (one of each kind speaks for all), they come together once more with their bytes, and their suffixes are
ordered by further passes of eight bytes each, in place, down to the threshold. A group of stretches that would not fit in
memory, and suffixes too far from a point, are ordered one by one by two digits of half the threshold each, in Spark's own
sort. Elsewhere a suffix has no equal: equal strings of 400 bytes hold the same points, at the same places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eralith.llm._spark import documents, id_filter, shared_runs, written
from eralith.llm._text import Texts, combine, covered, gathered, lists, mix, rolling_bytes, slices, spread, thinned

#: Bytes that decide on a point; one in so many positions is a point.
CONTEXT, EVERY = 16, 48
#: Stretches: suffixes that begin up to so many bytes before the next point, as shares of the threshold.
REACH = (0.24, 0.52, 0.84)


class _Stretches:
    """Stretches of suffixes of some texts: start, size, the next point, bytes held from there, whether content-defined."""

    def __init__(self, t: Texts, length: int):
        self.roll = rolling_bytes(t.data)
        size = np.diff(t.offsets)
        start = spread(t.offsets[:-1], np.where(size >= length, size - CONTEXT + 1, 0))
        point = start[mix(self.roll.ranges(start, start + CONTEXT)) < np.uint64((1 << 64) // EVERY)]
        # chunks: from a point, or a text's beginning, to the next point, or the last start of a whole string
        head = t.offsets[:-1][size >= length]
        begin = np.union1d(point, head)
        of = np.searchsorted(t.offsets, begin, "right") - 1
        stop = t.offsets[of + 1]
        ends = np.append(begin[1:], 0)
        last = np.append(of[1:] != of[:-1], True) if len(begin) else np.zeros(0, bool)
        ends[last] = stop[last]
        fixed = np.isin(begin, point)
        parts = []
        reach = [0, *(int(length * r) for r in REACH)]
        for near, far in zip(reach, reach[1:], strict=False):
            lo, hi = np.maximum(begin, ends - far), np.minimum(ends - near, stop - length + 1)
            use = ~last & (hi > lo) & (ends + length - far <= stop)
            parts.append([x[use] for x in (lo, hi - lo, ends, np.full(len(begin), length - far), of, (fixed | (lo > begin)) & (hi == ends - near))])
        self.start, self.size, self.next, self.held, self.of, self.fixed = (np.concatenate(x) for x in zip(*parts, strict=True))
        # suffixes of no stretch: too far before the next point, or before the text's end
        done = np.zeros(len(t.data) + 1, np.int64)
        np.add.at(done, self.start, 1)
        np.add.at(done, self.start + self.size, -1)
        free = spread(t.offsets[:-1], np.maximum(size - length + 1, 0))
        free = free[np.cumsum(done)[free] == 0]
        edge = np.flatnonzero(np.diff(free, prepend=-2) != 1) if len(free) else free
        run = np.diff(np.append(edge, len(free)))
        pieces = -(-run // _MOST)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        self.bare = np.repeat(free[edge], pieces) + nth * _MOST
        self.bare_size = np.minimum(np.repeat(run, pieces) - nth * _MOST, _MOST)
        self.bare_of = np.searchsorted(t.offsets, self.bare, "right") - 1


#: A reference packs a stretch's start, its size and how far before the point it begins (12 bits each).
_MOST = (1 << 12) - 1
#: Bytes of stretches that are ordered together; of one group that may be held.
BATCH, MOST_HELD = 1 << 21, 1 << 25
#: What becomes of a stretch or run of suffixes after the first pass.
OPEN, SETTLED, BARE = 0, 1, 2


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept): bytes in strings of ``length`` bytes that also start elsewhere.

    Elsewhere: at any other position of any row, the same row and rows with equal id or text included; strings never
    cross rows. spans holds the maximal removed runs, kept the other bytes. Null and empty texts: zeros, no spans and
    an empty kept. A row without id is left out. length below 64 leaves no room for points, above 4,095 none in a reference: ValueError.
    """
    if not 64 <= length <= _MOST:
        raise ValueError("length must be 64 to 4095 bytes")
    d = documents(docs, id_col, text_col)

    def first_digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, sig = (np.asarray(b.column(c)) for c in ("doc", "sig"))
            for t in slices(b.column(b.schema.get_field_index("text"))):
                p = _Stretches(t, length)
                of, local = p.of + t.first, p.start - t.offsets[p.of]
                f = combine(p.roll.ranges(p.next, p.next + p.held), p.held.astype(np.uint64))
                # a stretch that is not content-defined has a long digit of its own
                g = combine(mix(sig[of].view(np.uint64)), local.astype(np.uint64))
                g[p.fixed] = p.roll.ranges(p.start[p.fixed], (p.start + p.size)[p.fixed] + length - 1)
                yield pa.record_batch([pa.array(f.view(np.int64)), pa.array(g.view(np.int64)), sig[of], doc[of], pa.array(local << 24 | p.size << 12 | p.next - p.start)], names=["f", "g", "sig", "doc", "ref"])

    def bare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, sig = (np.asarray(b.column(c)) for c in ("doc", "sig"))
            for t in slices(b.column(b.schema.get_field_index("text"))):
                p = _Stretches(t, length)
                of = p.bare_of + t.first
                kind = np.full(len(of), BARE)
                yield pa.record_batch([doc[of], sig[of], pa.array(p.bare - t.offsets[p.bare_of] << 24 | p.bare_size << 12), pa.array(np.zeros(len(of), np.int64)), pa.array(kind)], names=["doc", "sig", "ref", "f", "kind"])

    ref = "doc long, sig long, ref long, f long, kind long"
    digits = d.mapInArrow(first_digits, "f long, g long, sig long, doc long, ref long")
    grouped = digits.repartition("f").sortWithinPartitions("f", "g", "sig", "doc", "ref").mapInArrow(_groups, ref)
    of_kind = lambda kind, what: F.collect_list(F.when(F.col("kind") == kind, what))
    every = grouped.unionByName(d.mapInArrow(bare, ref)).groupBy("doc", "sig")
    refs = written(every.agg(of_kind(SETTLED, F.col("ref")).alias("settled"), of_kind(OPEN, F.struct("f", "ref")).alias("open"), of_kind(BARE, F.col("ref")).alias("bare")))
    # equal texts: every one is repeated as a whole; only the one with the least id goes on as supplier
    sigs = d.select("doc", "sig", F.xxhash64(F.lit(1), F.col("text")).alias("sig2"))
    equal = sigs.groupBy("sig", "sig2").agg(F.min("doc").alias("least"), F.count("*").alias("n")).where("n > 1")
    copies = written(sigs.distinct().join(equal, ["sig", "sig2"]).select("doc", "sig", "least"))
    lone = refs.join(copies, ["doc", "sig"], "left").where("least is null or doc = least")
    open_ = written(lone.select("doc", "sig", "open.f", "open.ref").where(F.size("ref") > 0))

    def with_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, sig = (np.asarray(b.column(c)) for c in ("doc", "sig"))
            f, ref = (b.column(b.schema.get_field_index(c)) for c in ("f", "ref"))
            ends, fs, flat = ref.offsets.to_numpy(), np.asarray(f.values), np.asarray(ref.values)
            for t in slices(b.column(b.schema.get_field_index("text"))):
                part = slice(ends[t.first], ends[t.first + t.n])
                r, of = flat[part], np.repeat(np.arange(t.n), np.diff(ends[t.first : t.first + t.n + 1]))
                start = t.offsets[of] + (r >> 24)
                n = (r >> 12 & _MOST) + length - 1
                held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(r), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(n)]).astype(np.int64)), pa.py_buffer(t.data[spread(start, n)])])
                of = of + t.first
                yield pa.record_batch([pa.array(fs[part]), sig[of], doc[of], pa.array(r), held.cast(pa.binary())], names=["f", "sig", "doc", "ref", "bytes"])

    near = id_filter(open_, "doc")
    stretches = d.where(near(F.col("doc"))).join(open_, ["doc", "sig"]).select("doc", "sig", "text", "f", "ref").mapInArrow(with_bytes, "f long, sig long, doc long, ref long, bytes binary")
    ordered = stretches.repartition("f").sortWithinPartitions("f", "sig", "doc", "ref").mapInArrow(_ordered(length), "doc long, sig long, at long, to long, rest long")
    ordered = written(ordered)

    def every_suffix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, sig = (np.asarray(b.column(c)) for c in ("doc", "sig"))
            ref = b.column(b.schema.get_field_index("ref"))
            ends, flat = ref.offsets.to_numpy(), np.asarray(ref.values)
            for t in slices(b.column(b.schema.get_field_index("text"))):
                r = flat[ends[t.first] : ends[t.first + t.n]]
                base = np.repeat(t.offsets[:-1], np.diff(ends[t.first : t.first + t.n + 1]))
                start = spread(base + (r >> 24), r >> 12 & _MOST)
                of = np.searchsorted(t.offsets, start, "right") - 1
                roll, half = rolling_bytes(t.data), start + length // 2
                h, h2 = roll.ranges(start, half).view(np.int64), roll.ranges(half, start + length).view(np.int64)
                local = start - t.offsets[of]
                order, first, n = gathered(combine(h.view(np.uint64), h2.view(np.uint64)), of)
                lead = order[first]
                of, h, h2 = of[lead] + t.first, h[lead], h2[lead]
                # both digits decide, whole, on what a slice knows already
                by = np.lexsort((h2, h))
                parted = (np.diff(h[by], prepend=h[by[:1]]) != 0) | (np.diff(h2[by], prepend=h2[by[:1]]) != 0)
                key = np.empty(len(by), np.int64)
                key[by] = np.cumsum(parted)
                rows, own, known = thinned(key, sig[of], doc[of])
                of, h, h2 = of[rows], np.where(known, own, h[rows]), h2[rows]
                yield pa.record_batch([pa.array(h), pa.array(h2), sig[of], doc[of], pa.array(n[rows]), lists(pa.array(local[order]), n).take(pa.array(rows)), pa.array(known)], names=["h", "h2", "sig", "doc", "n", "at", "known"])

    one = lone.select("doc", "sig", F.explode("bare").alias("ref")).unionByName(ordered.where("rest is not null").select("doc", "sig", F.col("rest").alias("ref")))
    one = written(one.groupBy("doc", "sig").agg(F.collect_list("ref").alias("ref")))
    near = id_filter(one, "doc")
    every = (
        d.where(near(F.col("doc"))).join(one, ["doc", "sig"]).select("doc", "sig", "text", "ref")
        .mapInArrow(every_suffix, "h long, h2 long, sig long, doc long, n long, at array<long>, known boolean")
    )
    equal_suffixes = shared_runs(every, ["h", "h2"], ["n", "at"], "doc long, sig long, n long, at array<long>", between_texts=False)
    equal_suffixes = equal_suffixes.select("doc", "sig", F.explode("at").alias("at"))
    settled = refs.select("doc", "sig", F.explode("settled").alias("r"))
    settled = settled.select("doc", "sig", F.expr("shiftright(r, 24)").alias("at"), F.expr(f"shiftright(r, 24) + (shiftright(r, 12) & {_MOST}) + {length - 1}").alias("to"))
    spans = settled.unionByName(ordered.where("rest is null").select("doc", "sig", "at", "to")).unionByName(equal_suffixes.select("doc", "sig", "at", (F.col("at") + length).alias("to")))
    spans = spans.groupBy("doc", "sig").agg(F.array_sort(F.collect_list(F.struct("at", "to"))).alias("runs"))
    spans = spans.select("doc", "sig", F.col("runs.at").alias("at"), F.col("runs.to").alias("to"))
    known = written(spans.join(copies.select("doc", "sig", F.lit(True).alias("copy")), ["doc", "sig"], "full"))
    touched = id_filter(known, "doc")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = pa.scalar([], pa.list_(pa.int64()))
        for b in batches:
            doc, i = b.column(b.schema.get_field_index("doc")), b.schema.get_field_index("at")
            at, to = (pc.fill_null(b.column(b.schema.get_field_index(c)), empty) if i >= 0 else None for c in ("at", "to"))
            copy = np.asarray(pc.fill_null(b.column(b.schema.get_field_index("copy")), False)) if i >= 0 else None
            for t in slices(b.column(b.schema.get_field_index("text"))):
                rows = []
                for j, raw in enumerate(t.each()):
                    row, runs, kept = t.first + j, [], raw
                    if i >= 0:
                        if copy[row] and len(raw) >= length:
                            runs, kept = [(0, len(raw))], b""
                        else:
                            a, e = (np.asarray(x.values[x.offsets[row].as_py() : x.offsets[row + 1].as_py()]) for x in (at, to))
                            if len(a):
                                gone = np.concatenate([[False], covered(a, e, len(raw)), [False]]).astype(np.int8)
                                edge = np.diff(gone)
                                runs = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
                                kept = np.frombuffer(raw, np.uint8)[gone[1:-1] == 0].tobytes()
                    rows.append((len(raw), len(raw) - len(kept), len(runs), [{"start": x, "end": y} for x, y in runs], kept))
                n, removed, count, lists, kept = zip(*rows, strict=True)
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.record_batch([doc.slice(t.first, t.n), *(pa.array(x, pa.int64()) for x in (n, removed, count)), pa.array(lists, span), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary"
    plain = d.where(~touched(F.col("doc"))).select("doc", "text").mapInArrow(cut, schema)
    done = d.where(touched(F.col("doc"))).join(known, ["doc", "sig"], "left").select("doc", "text", "at", "to", "copy").mapInArrow(cut, schema)
    return plain.unionByName(done)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (f, g, sig, doc): settled where the long digit has two members, open where further passes are needed.

    A stream: all that is kept from batch to batch is the open group's two leaders.
    """
    key = f_lead = g_lead = None  # (f, g, sig, least doc); leaders still to be told of: (doc, sig, ref)
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        f, g, sig, doc, at = (np.asarray(b.column(c)) for c in ("f", "g", "sig", "doc", "ref"))
        new_f, new_g, new_s = (np.ones(n, bool) for _ in range(3))
        new_f[1:] = f[1:] != f[:-1]
        new_g[1:] = new_f[1:] | (g[1:] != g[:-1])
        new_s[1:] = new_g[1:] | (sig[1:] != sig[:-1])
        if key is not None:
            new_f[0] = f[0] != key[0]
            new_g[0] = new_f[0] or g[0] != key[1]
            new_s[0] = new_g[0] or sig[0] != key[2]
        least = np.full(n, key[3] if key is not None else 0, np.int64)
        places = np.flatnonzero(new_s)
        if len(places):
            least[places[0] :] = np.repeat(doc[places], np.diff(np.append(places, n)))
        key = (f[-1], g[-1], sig[-1], least[-1])
        rows = np.flatnonzero(doc == least)
        # the first row of a sub-group is always one that speaks
        lead_g, lead_f = new_g[rows], new_f[rows]
        docs, sigs, ats, fs = doc[rows], sig[rows], at[rows], f[rows]
        out = []

        def tell(d: np.ndarray, s: np.ndarray, a: np.ndarray, f: np.ndarray, kind: int, out: list = out) -> None:
            out.append((d, s, a, f, np.full(len(d), kind)))

        if not len(rows):
            continue
        member = ~lead_g  # second and later members of a sub-group: settled, and so is their leader
        tell(docs[member], sigs[member], ats[member], fs[member], SETTLED)
        led = np.flatnonzero(lead_g[:-1] & member[1:])
        tell(docs[led], sigs[led], ats[led], fs[led], SETTLED)
        if member[0] and g_lead is not None:
            tell(*(np.array([x]) for x in g_lead), SETTLED)
        # leaders after the first of a group need further passes, and so does the first then
        later = lead_g & ~lead_f
        tell(docs[later], sigs[later], ats[later], fs[later], OPEN)
        firsts = np.flatnonzero(lead_f)
        group = np.cumsum(lead_f)
        mixed = np.bincount(group, weights=later, minlength=len(firsts) + 1) > 0
        told = firsts[mixed[1:]]
        tell(docs[told], sigs[told], ats[told], fs[told], OPEN)
        if mixed[0] and f_lead is not None:
            tell(*(np.array([x]) for x in f_lead), OPEN)
            f_lead = None
        if len(firsts):
            i = firsts[-1]
            f_lead = None if mixed[-1] else (docs[i], sigs[i], ats[i], fs[i])
        g_lead = (docs[-1], sigs[-1], ats[-1], fs[-1]) if lead_g[-1] else None
        columns = (np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True))
        yield pa.record_batch([pa.array(x) for x in columns], names=["doc", "sig", "ref", "f", "kind"])


def radix_equal(data: np.ndarray, start: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Which of the strings data[start : start + length] equal another one of their group (group is sorted).

    Most significant digit first, eight bytes a digit: a pass orders just the groups that the digit parts, in the places that
    they hold already, and drops what stands alone. data has eight bytes more than the last string.
    """
    digits = np.ndarray((len(data) - 7,), ">u8", data, 0, (1,))
    alive, same = np.arange(len(start)), np.zeros(len(start), bool)
    for depth in [*range(0, length - 7, 8), length - 8]:
        new = np.ones(len(alive), bool)
        new[1:] = group[1:] != group[:-1]
        first = np.flatnonzero(new)
        several = np.repeat(np.diff(np.append(first, len(alive))) > 1, np.diff(np.append(first, len(alive))))
        alive, group, new = alive[several], group[several], new[several]
        if not len(alive):
            return same
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(alive)))
        digit = digits[start[alive] + depth]
        parted = digit != np.repeat(digit[first], size)
        if not parted.any():
            continue
        at = np.flatnonzero(np.repeat(np.logical_or.reduceat(parted, first), size))
        digit = digit.astype(np.uint64)
        by = np.lexsort((digit[at], group[at]))
        alive[at], digit[at] = alive[at][by], digit[at][by]
        new[1:] |= digit[1:] != digit[:-1]
        group = np.cumsum(new)
    new = np.ones(len(alive), bool)
    new[1:] = group[1:] != group[:-1]
    size = np.diff(np.append(np.flatnonzero(new), len(alive)))
    same[alive[np.repeat(size > 1, size)]] = True
    return same


def _ordered(length: int):
    def order(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        """Runs of equal suffixes of stretches that stand together by f, as (doc, sig, at, to)."""
        table = pa.Table.from_batches(rows).combine_chunks()
        f, sig, doc, ref = (np.asarray(table[c]) for c in ("f", "sig", "doc", "ref"))
        held = pc.cast(table["bytes"], pa.large_binary()).combine_chunks()
        held = held.chunk(0) if isinstance(held, pa.ChunkedArray) else held
        _, at, raw = held.buffers()
        at = np.frombuffer(at, np.int64)[held.offset : held.offset + len(held) + 1]
        data = np.concatenate([np.frombuffer(raw, np.uint8)[at[0] : at[-1]], np.zeros(8, np.uint8)])
        size, before = ref >> 12 & _MOST, ref & _MOST
        row = np.repeat(np.arange(len(f)), size)
        nth = spread(np.zeros(len(f), np.int64), size)
        # equal suffixes of a group begin equally far before the point
        part = np.cumsum(np.concatenate([[0], f[1:] != f[:-1]])) * (1 << 12)
        key = part[row] + before[row] - nth
        by = np.argsort(key, kind="stable")
        same = np.zeros(len(row), bool)
        same[by] = radix_equal(data, (at[:-1] - at[0])[row[by]] + nth[by], key[by], length)
        hit = np.flatnonzero(same)
        edge = np.ones(len(hit), bool)
        edge[1:] = (np.diff(hit) != 1) | (row[hit[1:]] != row[hit[:-1]])
        head = hit[edge]
        tail = hit[np.append(np.flatnonzero(edge)[1:] - 1, len(hit) - 1)] if len(hit) else hit
        of = row[head]
        begin = ref[of] >> 24
        return pa.record_batch([doc[of], sig[of], pa.array(begin + nth[head]), pa.array(begin + nth[tail] + length), pa.nulls(len(of), pa.int64())], names=_ORDERED)

    def too_large(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            none = pa.nulls(b.num_rows, pa.int64())
            yield pa.record_batch([b.column("doc"), b.column("sig"), none, none, b.column("ref")], names=_ORDERED)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole groups of f are held until they make a batch; of a group that grows too large nothing is held any more."""
        held, last, open_rows, open_bytes, rest = [], None, [], 0, False
        n_held = 0
        for b in batches:
            f = np.asarray(b.column("f"))
            cut = [0, *(np.flatnonzero(f[1:] != f[:-1]) + 1).tolist(), len(f)] if len(f) else []
            for x, y in zip(cut, cut[1:], strict=False):
                if f[x] != last:  # the open group is whole
                    held, n_held = held + open_rows, n_held + open_bytes
                    last, open_rows, open_bytes, rest = f[x], [], 0, False
                    if n_held >= BATCH:
                        yield order(held)
                        held, n_held = [], 0
                piece = b.slice(x, y - x)
                if not rest:
                    open_rows.append(piece)
                    open_bytes += piece.nbytes
                    rest = open_bytes > MOST_HELD
                    if rest:
                        yield from too_large(open_rows)
                        open_rows, open_bytes = [], 0
                else:
                    yield from too_large([piece])
        if held or open_rows:
            yield order(held + open_rows)

    return work


_ORDERED = ["doc", "sig", "at", "to", "rest"]


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Digest of repeated_spans over documents, strings of 400 bytes."""
    out = repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
