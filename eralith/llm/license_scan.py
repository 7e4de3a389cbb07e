"""License scans: matching statistics against a generalised suffix automaton of template tokens, chained into spans.

The automaton holds every token run of every template, so it is as small as the templates (some thousand states) and is
built once in each task. A text streams through it word by word: the state is the longest run ending here that occurs
in a template, and its length is the matching statistic. Matches of ``least_match`` tokens or more are placed in
their templates; those of one template that follow one another in text and template are chained, gaps allowed up
to ``most_gap`` words. A chain names its template's licence if it covers a share of the template or a number of words that
no accident reaches; of chains that overlap in the text the one that covers most stays, as licences share clauses.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eralith.llm._text import slices
from eralith.llm.license_texts import TEMPLATES

#: Base phrase -> label.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# lower case; every ASCII byte other than 0-9 and a-z parts words
_TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


class SuffixAutomaton:
    """Generalised suffix automaton over token sequences; each state knows one place of its longest run."""

    def __init__(self, sequences: list[list[bytes]]):
        self.arcs: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for s, tokens in enumerate(sequences):
            last = 0
            for i, token in enumerate(tokens):
                last = self._extend(last, token)
                self.ends[last].add((s, i))
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[state]] |= self.ends[state]

    def _add(self, length: int, arcs: dict[bytes, int], link: int) -> int:
        self.arcs.append(arcs)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.arcs) - 1

    def _split(self, p: int, token: bytes, q: int) -> int:
        """The state for runs up to length[p] + 1 alone, taken out of q."""
        part = self._add(self.length[p] + 1, dict(self.arcs[q]), self.link[q])
        self.link[q] = part
        while p >= 0 and self.arcs[p].get(token) == q:
            self.arcs[p][token] = part
            p = self.link[p]
        return part

    def _extend(self, last: int, token: bytes) -> int:
        q = self.arcs[last].get(token)
        if q is not None:  # an earlier template has this run
            return q if self.length[q] == self.length[last] + 1 else self._split(last, token, q)
        new = self._add(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and token not in self.arcs[p]:
            self.arcs[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.arcs[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, token, q)
        return new

    def matches(self, tokens: list[bytes], least: int) -> list[tuple[int, int, int]]:
        """(start, end, state) of the maximal matches of least tokens or more, by one pass over tokens."""
        found, state, n = [], 0, 0
        arcs, link, length = self.arcs, self.link, self.length
        for i, token in enumerate(tokens):
            to = arcs[state].get(token)
            if to is None:
                if n >= least:
                    found.append((i - n, i, state))
                while state and to is None:
                    state = link[state]
                    n = length[state]
                    to = arcs[state].get(token)
                if to is None:
                    state = n = 0
                    continue
            state, n = to, n + 1
        if n >= least:
            found.append((len(tokens) - n, len(tokens), state))
        return found


def chains(matches: list[tuple[int, int, int, int]], most_gap: int, longest: int) -> list[tuple[int, int, int, int]]:
    """Chains of (start, end, template, template start), best first: (template, covered, start, end).

    Matches of a chain follow one another, without overlap, in text and in template. Each match is the end of the best
    chain that it can end; chains of any templates are told from the one that covers most (then: the earlier template,
    the earlier place), and none that overlaps one told before in the text.
    """
    by: dict[int, list] = {}
    for m in sorted(set(matches), key=lambda m: (m[2], m[0], m[3])):
        by.setdefault(m[2], []).append(m)
    ends = []
    for template, ms in by.items():
        score: list[tuple[int, int]] = []  # covered so far, text start of the chain
        for i, (start, end, _, at) in enumerate(ms):
            top = (end - start, start)
            for j in range(i - 1, -1, -1):
                s, e, _, a = ms[j]
                if e <= start and a + e - s <= at and start - e <= most_gap and score[j][0] + end - start > top[0]:
                    top = (score[j][0] + end - start, score[j][1])
                if start - s > most_gap + longest:  # no match is longer than a template
                    break
            score.append(top)
            ends.append((-top[0], template, top[1], end))
    told: list[tuple[int, int, int, int]] = []
    starts: list[tuple[int, int]] = []  # text spans told, sorted
    for covered, template, start, end in sorted(ends):
        i = bisect_left(starts, (start, end))
        if (i and starts[i - 1][1] > start) or (i < len(starts) and starts[i][0] < end):
            continue
        starts.insert(i, (start, end))
        told.append((template, -covered, start, end))
    return told


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_match: int = 6, most_gap: int = 20, least_share: float = 0.3, least_words: int = 40
) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans), one row per row with an id.

    base_labels: labels of the phrases found; labels: those and the labels of templates of which least_share or
    least_words words are covered (license_texts lists the licences). score: the largest covered share, 1 where a phrase
    names a license. spans: (label, start, end, covered) of all chains that gave a label, in words, by start. Null and
    empty texts: zeros, nulls, no labels. A row without an id is left out; rows that repeat are scanned each.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    names = [label for label, _ in TEMPLATES]
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.int64())]))
    types = [pa.int64()] * 5 + [pa.list_(pa.string())] * 2 + [pa.float64(), span]
    fields = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequences = [words_of(t.encode()) for _, t in TEMPLATES]
        sizes = [len(s) for s in sequences]
        automaton = SuffixAutomaton(sequences)
        alphabet = {w for s in sequences for w in s}
        phrases = [(b" " + p.encode() + b" ", label) for p, label in PHRASES.items()]
        for b in batches:
            ids = b.column(0)
            for t in slices(b.column(1)):
                rows = []
                for raw in t.each():
                    words = words_of(raw)
                    joined = b" " + b" ".join(words) + b" "
                    places, base = [], set()
                    for phrase, label in phrases:
                        i, word, last = joined.find(phrase), 0, 0
                        while i >= 0:
                            word, last = word + joined.count(b" ", last, i), i
                            places.append(word)
                            base.add(label)
                            i = joined.find(phrase, i + 1)
                    found = []
                    for start, run in _runs(words, alphabet, least_match):
                        for s, e, state in automaton.matches(run, least_match):
                            found += [(start + s, start + e, k, end - (e - s) + 1) for k, end in automaton.ends[state]]
                    chained = [x for x in chains(found, most_gap, max(sizes)) if x[1] >= min(least_share * sizes[x[0]], least_words)] if found else []
                    spans = sorted((s, e, names[k], c) for k, c, s, e in chained)
                    share = max((c / sizes[k] for k, c, _, _ in chained), default=0.0)
                    rows.append((
                        len(words), len(places), min(places, default=None), max(places, default=None), sorted(base),
                        sorted(base | {x[2] for x in spans}), 1.0 if base else share,
                        [dict(zip(("start", "end", "label", "covered"), x, strict=True)) for x in spans],
                    ))
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([ids.slice(t.first, t.n), *(pa.array(c, ty) for c, ty in zip(columns, types[1:], strict=True))], names=fields)

    return d.mapInArrow(
        scan,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, "
        "score double, spans array<struct<label:string,start:long,end:long,covered:long>>",
    )


def _runs(words: list[bytes], alphabet: set[bytes], least: int) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of template words: at any other word the automaton is back in its first state."""
    known = np.fromiter(map(alphabet.__contains__, words), bool, len(words))
    if known.sum() < least:
        return
    edge = np.diff(np.concatenate([[0], known, [0]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    for k in np.flatnonzero(end - begin >= least).tolist():
        yield int(begin[k]), words[begin[k] : end[k]]


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    """Labels of license_scan over documents."""
    out = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = (F.array_join(c, ",").alias(c) for c in ("base_labels", "labels"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", *joined, "score", "spans")
