"""Fill-in-the-middle, sharding and the filter audit against brute-force versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from eralith.llm.filter_audit import adjacent_swaps, failure_cells, op13_filter_audit, orders
from eralith.llm.infilling import UNITS, Checkpoints, fill_in_middle, op11_fill_in_middle, rebuilt
from eralith.llm.sharding import PER_CHUNK, op12_sharding, rendezvous, shard_rows, write_shards
from tests.llm.test_operators import WORD, same, sha

CLASHES = "doc part mask sig n m text_crc32 shard slot range first at by from least output form docs".split()


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def infilled(d, t):
    h = hashlib.sha256(f"1:{d}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted(x % (len(t) + 1) for x in h[:2])
    if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 90:
        return "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    return ("spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(spark, sf_dir, rows):
    want = []
    for d, t, *_ in rows:
        form, p, m, out = infilled(d, t)
        want.append({"doc_id": d, "n": len(t), "form": form, "prefix_chars": p, "middle_chars": m, "output_sha256": sha(out), "restored_sha256": sha(t)})
    assert {r["form"] for r in want} == {"plain", "psm", "spm"}
    same(rows_of(op11_fill_in_middle(spark, sf_dir)), want)


def test_fill_in_middle_edges(spark):
    """Markers in a text, parts of markers at its cuts, code points of all lengths, a text longer than a stretch, nulls."""
    rng = random.Random(3)
    texts = ["a<P>b", "<M>", "<S", "<P<S<M", ">P>", "<" * 50, "\U0001f600é日a" * 9, "x", None, "", "日é\n" * 60_000, "".join(rng.choice("<PSM>") for _ in range(7))]
    docs = spark.createDataFrame([(i * 7 + j, t, 1) for i, t in enumerate(texts) for j in range(7)] + [(None, "lost", 1)], "doc_id long, text string, output int")
    out = rows_of(fill_in_middle(docs).withColumn("back", rebuilt(F.col("output"), F.col("form"))))
    assert len(out) == 7 * len(texts)
    for r in out:
        t = texts[r["doc_id"] // 7] or ""
        assert (r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == infilled(r["doc_id"], t) and r["back"] == t


@pytest.mark.parametrize("unit", list(UNITS))
def test_checkpoints(unit, monkeypatch):
    """Each unit's place against a plain cut of the text, with stretches and gaps of many sizes."""
    import numpy as np

    from eralith.llm import infilling

    pattern = {"char": r"[\s\S]", "word": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", "line": r"[^\n]*\n|[^\n]+"}[unit]
    rng = random.Random(1)
    for stretch in (3, 64, 1 << 16):
        monkeypatch.setattr(infilling, "STRETCH", stretch)
        for size in (0, 1, 5, 40, 6000):
            t = "".join(rng.choice("ab \n\té日\U0001f600") for _ in range(size))
            places = [m.start() for m in re.finditer(pattern, t)] + [len(t)]
            for every in (1, 7, 512):
                index = Checkpoints(np.frombuffer(t.encode(), np.uint8), unit, every)
                assert (index.units, index.points) == (len(places) - 1, len(t))
                assert index.number == list(range(0, index.units, every))
                for k in {0, 1, index.units // 2, index.units - 1, index.units} & set(range(index.units + 1)):
                    assert index.locate(k) == (len(t[: places[k]].encode()), places[k])


def test_fill_in_middle_units(spark):
    text = " one two  three\nfour five \n\nsix"
    df = spark.createDataFrame([(i, text) for i in range(60)], "doc_id long, text string")
    for unit, n in (("word", 6), ("line", 4)):
        got = rows_of(fill_in_middle(df, unit=unit, plain_percent=0).select("*", rebuilt(F.col("output"), F.col("form")).alias("back")))
        assert {r["n"] for r in got} == {n} and {r["back"] for r in got} == {text} and {r["form"] for r in got} == {"psm", "spm"}
        cuts = {m.end() for m in re.finditer({"word": r"\s*\S+", "line": r"[^\n]*\n"}[unit], text)} | {0, len(text)}
        assert all({r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]} <= cuts for r in got)
    with pytest.raises(ValueError, match="markers"):
        fill_in_middle(df, markers=("<a", "a>", "b"))


def test_sharding(spark, sf_dir, rows):
    """Shards by their definition; slots gapless and in the order of content; growth takes keys only into the new shard."""
    import math

    def score(d, s):
        return -1 / math.log((int(hashlib.md5(f"{s}:{d}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52)

    got, want, place = rows_of(op12_sharding(spark, sf_dir)), [], {}
    for d, t, *_ in rows:
        shard, grown = (max(range(n), key=lambda s, d=d: score(d, s)) for n in (8, 9))
        crc = zlib.crc32(t.encode())
        want.append({"doc_id": d, "size": len(t.encode()) + 1, "text_crc32": crc, "law": "key", "shard": shard, "grown_shard": grown})
        place.setdefault(shard, []).append((hashlib.md5(f"{d}:{crc}".encode()).hexdigest(), d))
    same(got, want)
    slots = defaultdict(dict)
    for r in got:
        slots[r["shard"]][r["slot"]] = r["doc_id"]
    assert {s: [x[k] for k in range(len(x))] for s, x in slots.items()} == {s: [d for _, d in sorted(x)] for s, x in place.items()}


def test_sharding_ranges_and_copies(spark, monkeypatch):
    """Many ranges, an id with many texts and a row that stands more often than one row is expanded to at once."""
    from eralith.llm import sharding

    monkeypatch.setattr(sharding, "PER_RANGE", 50)
    df = spark.range(1500).selectExpr("id as doc_id", "repeat('x', cast(id % 40 as int)) as text")
    df = df.unionByName(spark.range(700).selectExpr("5L as doc_id", "concat('t', id) as text")).unionByName(spark.range(PER_CHUNK * 2 + 5).selectExpr("9L as doc_id", "cast(null as string) as text"))
    got = rows_of(shard_rows(df.repartition(7), weights=(1, 2, 3)))
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert len(got) == df.count() and all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) == {0, 1, 2}
    assert len({r["shard"] for r in got if r["doc_id"] == 5}) == 1
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in rows_of(shard_rows(df.repartition(3), weights=(1, 2, 3)))) == sorted((r["doc_id"], r["shard"], r["slot"]) for r in got)


def test_rendezvous_weights(spark):
    """Shares follow weights; a shard that is added takes its share and nothing else moves; more weight only takes keys in."""
    key = F.col("id").cast("string")
    of = lambda *weights: [r[0] for r in spark.range(20_000).select(rendezvous(key, weights)).collect()]
    before, after, heavier = of(1, 2, 1), of(1, 2, 1, 1), of(1, 2, 3)
    for counted, weights in ((Counter(before), (1, 2, 1)), (Counter(after), (1, 2, 1, 1))):
        for s, w in enumerate(weights):
            assert abs(counted[s] / 20_000 - w / sum(weights)) < 0.015
    assert all(b in (a, 3) for a, b in zip(before, after, strict=True)) and all(b in (a, 2) for a, b in zip(before, heavier, strict=True))
    assert set(of(0.5)) == {0}
    with pytest.raises(ValueError, match="weight"):
        of(1, 0)


def test_write_shards(spark, tmp_path, sf_dir, rows):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("*", "1 as Shard", "2 as part")
    name = write_shards(docs, f"{tmp_path}/out", rows_per_file=2)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert name == "_shard" and sorted(back.columns) == sorted([*docs.columns, name])
    want = {(r["doc_id"], r["shard"]) for r in rows_of(shard_rows(docs))}
    assert {(r["doc_id"], r["_shard"]) for r in rows_of(back)} == want and back.count() == len(rows)


def failed(rows):
    """What each of some rows (id, text, ...) fails, by plain Python."""
    first = {}
    for d, t, *_ in rows:
        first[t] = min(first.get(t, d), d)
    out = []
    for d, t, *_ in rows:
        w = WORD.findall(t)
        conditions = len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), re.search("[#$%&*|]", t), first[t] < d
        out.append({x for x, c in zip("ABCDE", conditions, strict=True) if c})
    return out


def audited(parts, fails, good, toxic):
    want, alone = [], lambda x, p: sum(q == p and f == {x} for q, f in zip(parts, fails, strict=True))
    for p in set(parts):
        shapley, mine = Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = {i for i, q in enumerate(parts) if q == p}
            for k, x in enumerate(order, 1):
                gone = {i for i in left if x in fails[i]}
                all_fail = sum(q == p and x in f for q, f in zip(parts, fails, strict=True))
                left -= gone
                shapley[x] += len(gone)
                mine.append({"part": p, "filter_order": "".join(order), "step": k, "kept": len(left), "removed": len(gone), "redundant": all_fail - len(gone), "unique_fails": alone(x, p), "good_lost": sum(good[i] for i in gone), "toxic_lost": sum(toxic[i] for i in gone)})
        want += [r | {"shapley": shapley[r["filter_order"][r["step"] - 1]]} for r in mine]
    return want


def test_filter_audit(spark, sf_dir, rows, tmp_path):
    ids = sorted({r[0] for r in rows})
    labels = [(d, i % 2, i % 3 == 0) for i, d in enumerate(ids) if i % 5] + [(ids[1], 1, True), (ids[2], None, None), (None, 1, True), (-5, 1, True)]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.selectExpr("*", *(f"1 as {c}" for c in CLASHES)).write.parquet(f"{tmp_path}/documents.parquet")
    df = spark.createDataFrame([(d, q, None if t is None else int(t)) for d, q, t in labels], "doc_id long, quality int, toxic int")
    df.selectExpr("*", "7 as text", "8 as good").write.parquet(f"{tmp_path}/labels.parquet")
    good, toxic = ({d for d, *v in labels if v[k] == 1} for k in (0, 1))
    got = rows_of(op13_filter_audit(spark, str(tmp_path)))
    want = audited([r[2] or "" for r in rows], failed(rows), [r[0] in good for r in rows], [r[0] in toxic for r in rows])
    assert "" in {r["part"] for r in got} and len(got) == 600 * len({r["part"] for r in got}) and any(r["toxic_lost"] for r in got)
    same(got, want)


def test_copies_across_parts(spark):
    """The least id of a text is one for all parts and labels, also where its row stands several times."""
    rows = [(5, "t", "a"), (5, "t", "a"), (7, "t", "a"), (6, "t", "b"), (5, "u", "b"), (9, None, None), (8, "", "b"), (8, "", "b"), (None, "t", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(7, 1), (5, 0)], "doc_id long, q int")
    got = {(r["part"], r["mask"]): (r["n"], r["good"]) for r in rows_of(failure_cells(docs, {}, copies="E", labels=labels, sums={"good": "q = 1"})) if r["n"]}
    assert got == {("a", 0): (2, 0), ("a", 1): (1, 1), ("b", 0): (3, 0), ("b", 1): (1, 0), ("", 1): (1, 0)}
    plain = {(r["part"], r["mask"]): r["n"] for r in rows_of(failure_cells(docs, {"X": lambda t: t == "t"}))}
    assert plain == {("a", 1): 3, ("b", 1): 1, ("b", 0): 3, ("", 0): 1}


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_orders(spark, k):
    """Each order comes once, one swap from the one before; with names of more than one letter; shares of all orders add up."""
    seen, order = [tuple(range(k))], list(range(k))
    for i in adjacent_swaps(k):
        order[i], order[i + 1] = order[i + 1], order[i]
        seen.append(tuple(order))
    assert sorted(seen) == sorted(itertools.permutations(range(k)))
    rng = random.Random(k)
    cells = [(f"p{p}", m, rng.randrange(9)) for p in range(70) for m in range(1 << k)]
    got = rows_of(orders(spark.createDataFrame(cells, "part string, mask int, n int"), [f"f{i}" for i in range(k)], []))
    assert len(got) == 70 * len(seen) * k
    for p in ("p0", "p69"):
        gone = sum(n for q, m, n in cells if q == p and m)
        shapley = {r["filter_order"].split(",")[r["step"] - 1]: r["shapley"] for r in got if r["part"] == p}
        assert sum(shapley.values()) == gone * len(seen)
        assert {r["kept"] for r in got if r["part"] == p and r["step"] == k} == {sum(n for q, m, n in cells if q == p and not m)}


@pytest.mark.parametrize("query", [op11_fill_in_middle, op12_sharding, op13_filter_audit])
def test_empty_and_clashing(spark, query, empty_dir, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "a b", "en"), (2, None, None)], "doc_id long, text string, lang string").selectExpr("*", *(f"'7' as `{c}`" for c in CLASHES))
    none = spark.read.parquet(f"{empty_dir}/documents.parquet")
    for name, table in (("some", docs), ("none", none)):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    some, nothing = (query(spark, f"{tmp_path}/{x}") for x in ("some", "none"))
    assert nothing.collect() == [] and some.schema == nothing.schema
    assert len(some.collect()) == (1200 if query is op13_filter_audit else 2)
