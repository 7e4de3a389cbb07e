"""Columns of queries without SQL against plain Python over a whole table of the driver's, where it is there."""

import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from eralith.llm.queries import QUERIES
from tests.llm.test_operators import WORD, lower, same

SF = Path("/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="driver tables are absent")
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text or "", r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_packing(spark, docs):
    """Every piece of every text once, and what a bin may hold."""
    got = [r.asDict() for r in QUERIES["op9_best_fit_packing"](spark, str(SF)).collect()]
    want = []
    for d, t, _ in docs:
        n = len(WORD.findall(t))
        want += [{"doc_id": d, "piece": k, "start": k * 2047, "n_tokens": min(n - k * 2047, 2047) + 1} for k in range(max(-(-n // 2047), 1))]
    same(got, want)
    text, source = {d: t for d, t, _ in docs}, {d: s for d, _, s in docs}
    bins = defaultdict(list)
    for r in got:
        bins[r["bin_group"], r["bin"]].append(r)
    for rows in bins.values():
        used = sum(r["n_tokens"] for r in rows)
        assert {r["residual"] for r in rows} == {2048 - used} and used <= 2048
        assert max(Counter(source[r["doc_id"]] for r in rows).values()) <= 4
        assert len({text[r["doc_id"]] for r in rows}) == len(rows)


def test_licenses(spark, docs):
    """Words, places of phrases and their labels of every whole text."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = []
    for d, t, _ in docs:
        w = word.findall(lower(t))
        places = [(i, label) for p, label in PHRASES.items() for k in [p.split()] for i in range(len(w) - len(k) + 1) if w[i : i + len(k)] == k]
        at = [i for i, _ in places]
        want.append({
            "doc_id": d, "n_words": len(w), "n_base": len(places), "first_word": min(at, default=None), "last_word": max(at, default=None),
            "base_labels": ",".join(sorted({x for _, x in places})),
        })
    got = [r.asDict() for r in QUERIES["op10_license_scan"](spark, str(SF)).collect()]
    assert sum(r["n_base"] for r in want)
    same(got, want)
    for r in got:
        base, labels = (set(filter(None, r[c].split(","))) for c in ("base_labels", "labels"))
        assert base <= labels and r["labels"] == ",".join(sorted(labels)) and 0 <= r["score"] <= 1


def test_three_new_ones_hold_together(spark, docs):
    """Facts that hold on a whole table whatever the draws: exact restoration, gapless slots, counts that add up."""
    import hashlib

    sha = {d: hashlib.sha256(t.encode()).hexdigest() for d, t, _ in docs}
    filled = QUERIES["op11_fill_in_middle"](spark, str(SF)).collect()
    assert all(r.restored_sha256 == sha[r.doc_id] for r in filled) and len(filled) == len(docs)
    assert all((r.output_sha256 == sha[r.doc_id]) == (r.form == "plain") for r in filled)
    shards = defaultdict(list)
    for r in QUERIES["op12_sharding"](spark, str(SF)).collect():
        shards[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert sorted(shards) == list(range(8)) and all(sorted(x) == list(range(len(x))) for x in shards.values())
    rows = QUERIES["op13_filter_audit"](spark, str(SF)).collect()
    by = defaultdict(dict)
    for r in rows:
        by[r.part, r.filter_order][r.step] = r
    parts = Counter(r.lang or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert len(by) == 120 * len(parts) and len({(p, by[p, o][5].kept) for p, o in by}) == len(parts)
    for (part, _), steps in by.items():
        left = parts[part]
        for k in range(1, 6):
            left -= steps[k].removed
            assert steps[k].kept == left and steps[k].removed >= steps[k].unique_fails
        assert sum(s.shapley for s in steps.values()) == 120 * (parts[part] - left)
