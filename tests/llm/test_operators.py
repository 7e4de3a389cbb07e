"""Each query against a brute-force version over one small fixture, and the defined results of edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from eralith.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def lower(t):
    return t.translate({i: i + 32 for i in range(65, 91)})


def run(spark, sf_dir, n):
    name = next(k for k in QUERIES if k.startswith(f"op{n}_"))
    return [r.asDict() for r in QUERIES[name](spark, sf_dir).collect()]


def same(got, want):
    """want: rows (dicts) with some of the columns of got, in any order."""
    pick = lambda r: tuple(sorted((k, r[k]) for k in want[0]))
    assert Counter(map(pick, got)) == Counter(map(pick, want))


def test_substring_dedup(spark, sf_dir, rows):
    first = {}
    for d, t, *_ in rows:
        w = WORD.findall(t)
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            first[k] = min(first.get(k, d), d)
    want = []
    for d, t, *_ in rows:
        w = WORD.findall(t)
        gone = {j for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < d for j in range(i, i + 50)}
        want.append({"doc_id": d, "n_words": len(w), "n_removed": len(gone), "kept_sha256": sha(" ".join(x for j, x in enumerate(w) if j not in gone))})
    assert sum(r["n_removed"] for r in want)
    same(run(spark, sf_dir, 1), want)


def test_lm_scoring(spark, sf_dir, rows):
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    tokens = [(d, [*WORD.findall(lower(t)), None]) for d, t, *_ in rows]
    c = Counter(w for d, ws in tokens if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    got = run(spark, sf_dir, 2)
    same(got, [{"doc_id": d, "held_out": held(d), "n_tokens": len(ws), "n_known": sum(w in c for w in ws), "train_tokens": n} for d, ws in tokens])
    base = {d: sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws) for d, ws in tokens}
    # the model by its definition, without an automaton
    pairs = Counter(p for d, ws in tokens if not held(d) for p in zip([0, *ws], ws, strict=False))
    start = sum(not held(d) for d, _ in tokens)
    once, twice = (sum(x == k for x in c.values()) for k in (1, 2))
    cut = min(0.9, max(0.1, once / (once + 2 * twice)))
    word = lambda w: (c[w] - cut) / n if c[w] else cut * v / n
    given = lambda h, w: (pairs[h, w] + 200 * word(w)) / ((start if h == 0 else c[h]) + 200)
    score = {d: sum(math.log10(given(h, w)) for h, w in zip([0, *ws], ws, strict=False)) for d, ws in tokens}
    for r in got:
        assert r["base_score"] == pytest.approx(base[r["doc_id"]])
        assert r["score"] == pytest.approx(score[r["doc_id"]])


@pytest.mark.parametrize("order", [1, 2, 3, 4])
@pytest.mark.parametrize("trained", [True, False])
def test_lm_walk(spark, order, trained):
    """The automaton's walk against probabilities by their definition, on texts longer than a piece of the walk."""
    import random

    from pyspark.sql import functions as F

    from eralith.llm.lm_scoring import lm_scores

    rng = random.Random(order)
    docs = [(i, " ".join(rng.choice("abcdef" if i < 20 else "abcdefgh") for _ in range(rng.choice([0, 1, 2, 5, 40, 700])))) for i in range(40)]
    got = {r.doc_id: r.score for r in lm_scores(spark.createDataFrame(docs, "doc_id long, text string"), F.col("doc_id") >= (20 if trained else 0), order=order, prior=3.0).collect()}
    learn = [[*t.split(), None] for d, t in docs if trained and d < 20]
    grams = Counter(tuple(ws[max(i - k, 0) : i + 1]) if i >= k else (0, *ws[: i + 1]) for ws in learn for i in range(len(ws)) for k in range(order) if i >= k - 1)
    c = Counter(w for ws in learn for w in ws)
    n, v = sum(c.values()), len(c)
    once, twice = (sum(x == k for x in c.values()) for k in (1, 2))
    cut = min(0.9, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5

    def prob(h, w):
        if not h:
            return ((c[w] - cut) / n if c[w] else cut * v / n) if n else 1.0
        held = len(learn) if h == (0,) else grams[h]
        return (grams[(*h, w)] + 3 * prob(h[1:], w)) / (held + 3) if held else prob(h[1:], w)

    for d, t in docs:
        ws = [0, *t.split(), None]
        want = sum(math.log10(prob(tuple(ws[max(i - order + 1, 0) : i]), ws[i])) for i in range(1, len(ws)))
        assert got[d] == pytest.approx(want), d


@pytest.mark.parametrize("order", [1, 3])
def test_lm_ranges(spark, monkeypatch, order):
    """Blocks that are added up by ranges give the same scores and counts as all at once."""
    import random

    from pyspark.sql import functions as F

    from eralith.llm import lm_scoring

    rng = random.Random(order)
    docs = [(i, " ".join(rng.choice(["a", "b", f"w{rng.randrange(300)}"]) for _ in range(rng.randrange(80)))) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(30)
    score = lambda: sorted(tuple(r) for r in lm_scoring.lm_scores(df, F.col("doc_id") % 7 == 2, order=order).collect())
    whole = score()
    monkeypatch.setattr(lm_scoring, "BLOCKS_PER_RANGE", 4)
    parts = score()
    assert [r[:5] for r in parts] == [r[:5] for r in whole] and len(parts) == 300
    assert all(a == pytest.approx(b) for x, y in zip(parts, whole, strict=True) for a, b in zip(x[5:], y[5:], strict=True))


@pytest.mark.parametrize("order", [1, 3])
def test_lm_orders(spark, sf_dir, rows, order):
    """Probabilities of what may follow a text's beginning add up to one."""
    from pyspark.sql import functions as F

    from eralith.llm.lm_scoring import lm_scores

    train = [(i, " ".join(x)) for i, x in enumerate(["abc", "abd", "aab", "bca"], 1)]
    ask = [(100 + i, " ".join(["a", "b", w])) for i, w in enumerate("abcdz")]
    got = {r.doc_id: r.score for r in lm_scores(spark.createDataFrame(train + ask, "doc_id long, text string"), F.col("doc_id") >= 100, order=order, prior=2.0).collect()}
    prefix = lm_scores(spark.createDataFrame([*train, (100, "a b")], "doc_id long, text string"), F.col("doc_id") >= 100, order=order, prior=2.0)
    assert all(v < 0 for v in got.values())
    if order == 3:
        assert got[102] > got[104] and got[103] > got[104]
    assert prefix.count() == 5


def test_lm_counts_beyond_32_bits():
    """Blocks whose counts add up to more than 2^32 - 1 get the exact sum; others keep the short form."""
    import numpy as np
    import pyarrow as pa

    from eralith.llm import lm_scoring

    keys, counts = [np.array(x, "<u8") for x in ([5, 9], [5], [9])], [np.array(x, "<u4") for x in ([4_000_000_000, 3], [4_000_000_000], [4])]
    table = pa.table({
        "shard": [0] * 3, "block": [1, 2, 3], "n": [1] * 3,
        "keys": pa.array([x.tobytes() for x in keys], pa.binary()), "counts": pa.array([x.tobytes() for x in counts], pa.binary()),
    })
    out = lm_scoring._answer(table).to_pylist()
    assert [np.frombuffer(r["counts"], t).tolist() for r, t in zip(out, ("<u8", "<u8", "<u4"), strict=True)] == [[8_000_000_000, 7], [8_000_000_000], [7]]
    assert [lm_scoring._unpacked(r["counts"], len(k)).tolist() for r, k in zip(out, keys, strict=True)] == [[8_000_000_000, 7], [8_000_000_000], [7]]
    assert out[0]["facts"][0] == 8_000_000_007


def test_fingerprint(spark, sf_dir, rows):
    ids = sorted({d for d, *_ in rows})
    text = dict((d, t) for d, t, *_ in rows)
    got = run(spark, sf_dir, 3)
    want = []
    for d, t, *_ in rows:
        nxt, h = text[ids[ids.index(d) - 1]], len(t) // 2
        want.append({"doc_id": d, "n_chars": len(t), "edited_sha256": sha(t[: len(t) - h] + nxt[:h])})
    same(got, want)
    def sketch(t):
        words = WORD.findall(t)
        hashes = set()
        for i in range(max(len(words) - 4, min(len(words), 1))):
            h = 42  # Spark's hash of an array: each element's, seeded with the one before
            for x in words[i : i + 5]:
                h = xxhash.xxh64(x.encode(), seed=h).intdigest()
            hashes.add(h >> 4)
        return {h for h in hashes if h < (1 << 60) // 8 or h == min(hashes)}

    spell = lambda s: "".join(f"{h:015x}" for h in sorted(s))
    likeness = lambda a, b: len(a & b) / min(len(a), len(b)) if a and b else float(len(a) == len(b))
    want = []
    for d, t, *_ in rows:
        nxt, h = text[ids[ids.index(d) - 1]], len(t) // 2
        own, edited, other = sketch(t), sketch(t[: len(t) - h] + nxt[:h]), sketch(nxt)
        want.append({"doc_id": d, "fingerprint": spell(own), "edited_fingerprint": spell(edited), "near_edited": likeness(own, edited), "near_next": likeness(own, other)})
    same(got, want)


def test_sketches_merge(spark):
    from pyspark.sql import functions as F

    from eralith.llm.fingerprint import merge_sketches, with_sketch

    a, b = " ".join(map(str, range(300))), " ".join(map(str, range(1000, 1500)))
    df = spark.createDataFrame([(a, b, a)], "a string, b string, c string")
    for c in ("a", "b", "c"):
        df = with_sketch(df, c, f"s{c}")
    r = df.select("sa", "sb", merge_sketches(F.col("sa"), F.col("sb")).alias("m"), merge_sketches(F.col("sa"), F.col("sc")).alias("same")).first()
    assert r.same == r.sa and set(r.m) <= set(r.sa) | set(r.sb) and len(r.m) >= len(r.sa) + len(r.sb) - 1


def components(sets, percent):
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {d: top(d) for d in sets}


def shingles(t, k):
    w = WORD.findall(lower(t))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def test_ngram_join(spark, sf_dir, rows):
    sets = {d: shingles(t, 4) for d, t, *_ in rows}
    root = components(sets, 85)
    assert len(set(root.values())) < len(root) - 2
    same(run(spark, sf_dir, 4), [{"doc_id": d, "n_shingles": len(sets[d]), "component_id": root[d]} for d, *_ in rows])


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80), (1, 50), (2, 100)])
def test_ngram_join_contained(spark, k, percent):
    """Short sets that lie whole in one of a shingle more: the same components as by brute force."""
    from eralith.llm.ngram_join import jaccard_components

    docs = [(100 * n + j, " ".join(f"v{n}x{i}" for i in range(n + j))) for n in range(1, 13) for j in range(2)]
    docs += [(5000 + n, " ".join(f"v{n}x{i}" for i in range(n)) + " w") for n in range(1, 13)]
    sets = {d: shingles(t, k) for d, t in docs}
    want = components(sets, percent)
    assert (k, percent) != (4, 85) or want[901] == 900
    got = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), k=k, percent=percent).collect()}
    assert got == want


def test_ngram_join_large_groups(spark, monkeypatch):
    """Chains of near copies beyond a block and a short list: the same components as by brute force."""
    import random

    from eralith.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "SHORT_LIST", 8)
    rng, docs = random.Random(3), []
    for g in range(4):
        base = [f"w{rng.randrange(400)}" for _ in range(90)]
        for i in range(60):
            t = list(base)
            for j in range(rng.randrange(5)):
                t[(i * 7 + j * 31) % 90] = f"y{rng.randrange(60)}"
            docs.append((g * 1000 + i, " ".join(t)))
    sets = {d: shingles(t, 4) for d, t in docs}
    want = components(sets, 85)
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want


def test_ngram_join_repeated_ids(spark):
    """An id with two texts links the groups of both; rows of equal id and text are told once each."""
    from eralith.llm.ngram_join import jaccard_components

    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    docs = [(1, a + " x"), (5, a), (5, b), (5, b), (7, b + " y"), (8, c), (9, c + " z"), (3, b)]
    got = jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (3, 1), (5, 1), (5, 1), (5, 1), (7, 1), (8, 8), (9, 8)]


def test_bpe(spark, sf_dir, rows):
    import numpy as np
    import public_tokenizers as p
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    want = []
    for d, text, *_ in rows:
        ids = t.encode(text, add_special_tokens=False).ids
        want.append({"doc_id": d, "n_tokens": len(ids), "ids_sha256": sha(np.array(ids, "<u4").tobytes()), "decoded_sha256": sha(t.decode(ids, skip_special_tokens=False))})
    same(run(spark, sf_dir, 5), want)


def test_bpe_random_words():
    import random

    import public_tokenizers as p
    from tokenizers import Tokenizer

    from eralith.llm.bpe import Vocabulary

    path = p.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        v = Vocabulary(f.read())
    t, rng = Tokenizer.from_file(path), random.Random(1)
    letters = ["abcdefghij", "ab", "etaoin shr", "0123456789", "éèñ日本語ß", "=-_*#", "the ing er", "\n\t \x0b\x85  \x1c"]
    texts = ["".join(rng.choice(a) for _ in range(rng.randrange(1, 40))) for a in letters for _ in range(400)] + ["a" * 99, " " * 50]
    words = sorted({w for x in texts for w in v.pattern.findall(x)})
    coded = dict(zip(words, v.encode_words([w.encode() for w in words]), strict=True))
    import numpy as np

    for x in texts:
        ours = np.frombuffer(b"".join(coded[w] for w in v.pattern.findall(x)), "<u4").tolist()
        assert ours == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_suffix_dedup(spark, sf_dir, rows):
    data = [(d, t.encode()) for d, t, *_ in rows]
    count = Counter(b[i : i + 400] for _, b in data for i in range(len(b) - 399))
    want = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if count[b[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        runs = len(re.findall(b"\1+", bytes(gone)))
        want.append({"doc_id": d, "n_bytes": len(b), "n_removed": sum(gone), "n_spans": runs, "kept_sha256": sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))})
    assert sum(r["n_removed"] for r in want)
    same(run(spark, sf_dir, 6), want)


def test_suffix_dedup_random(spark):
    """Shifted and overlapping repeats with mismatched surroundings, for a short threshold."""
    import random

    from eralith.llm.suffix_dedup import repeated_spans

    rng = random.Random(11)
    piece = ["".join(rng.choice("abcdefgh \n") for _ in range(rng.randrange(60, 300))) for _ in range(12)]
    docs = [(i, "".join(p[rng.randrange(30) : len(p) - rng.randrange(30)] for p in rng.sample(piece, 4)) + "z" * rng.randrange(0, 250)) for i in range(150)]
    got = {r.doc_id: (r.n_removed, bytes(r.kept)) for r in repeated_spans(spark.createDataFrame(docs, "doc_id long, text string"), length=100).collect()}
    count = Counter(t[i : i + 100] for _, t in docs for i in range(len(t) - 99))
    for d, t in docs:
        gone = {j for i in range(len(t) - 99) if count[t[i : i + 100]] > 1 for j in range(i, i + 100)}
        assert got[d] == (len(gone), "".join(x for j, x in enumerate(t) if j not in gone).encode())


def test_quality_rules(spark, sf_dir, rows):
    want = []
    for d, t, *_ in rows:
        w = WORD.findall(t)
        five = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        c = Counter(five)
        rep = len({j for i, x in enumerate(five) if c[x] > 1 for j in range(i, i + 5)})
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append({
            "doc_id": d, "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_dup_lines": len(lines) - len(set(lines)),
            "n_repeat_words": rep, "base_failed": len(w) < 10 or 100 * rep > 20 * len(w),
        })
    got = run(spark, sf_dir, 7)
    same(got, want)
    assert not any(r["kept"] and r["base_failed"] for r in got) and any(r["kept"] for r in got)


def test_quality_adapts(spark):
    """A source whose texts all carry many symbols keeps them; one stray among plain texts goes."""
    from eralith.llm.quality_rules import quality_rules

    plain = " ".join(f"w{i}" for i in range(40))
    marked = " ".join(f"w{i} ##" for i in range(40))
    docs = [(i, f"{plain} p{i}", "en", "prose") for i in range(600)] + [(1000 + i, f"{marked} m{i}", "en", "code") for i in range(600)] + [(5000, marked, "en", "prose")]
    kept = {r.doc_id: r.kept for r in quality_rules(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()}
    assert not kept.pop(5000) and all(kept.values())


def test_quality_fences_follow_groups(spark):
    """Where texts of a source never repeat lines or phrases, a text that does so goes, however low the share; a trace stays."""
    from eralith.llm.quality_rules import quality_rules

    line = lambda d, i: " ".join(f"w{d}x{i}x{j}" for j in range(4))
    text = lambda d, n: "\n".join(line(d, i) for i in range(n))
    half = "\n".join(x for i in range(49) for x in ([line(1000, i)] if i else [line(1000, 0)] * 48))
    phrases = text(2000, 100) + "\n" + text(2000, 8)
    one = text(3000, 60) + "\n" + line(3000, 0)
    docs = [(d, text(d, 50), "en", "prose") for d in range(600)] + [(1000, half, "en", "prose"), (2000, phrases, "en", "prose"), (3000, one, "en", "prose")]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()}
    assert 0.4 < got[1000].n_dup_lines / got[1000].n_lines < 0.5 and "dup_line_share" in got[1000].reasons
    assert not got[2000].base_failed and "repeat_share" in got[2000].reasons
    assert got[3000].kept and all(got[d].kept for d in range(600))


def test_quality_fences_decide(spark):
    """Groups have fences of their own, above zero, and verdicts follow them: with two groups' fences swapped, others go."""
    import random

    from pyspark.sql import functions as F

    from eralith.llm.quality_rules import MEASURES, group_counts, group_fences, verdicts

    rng = random.Random(8)

    def text(n, marks, lines=5):
        return "\n".join(" ".join(rng.choice(["#", "|"]) if rng.random() < marks else f"w{rng.randrange(10**6)}" for _ in range(n)) for _ in range(lines))

    docs = [(i, text(rng.randrange(8, 60), 0.3 if i % 20 == 0 else 0), "en", "prose") for i in range(800)]
    docs += [(1000 + i, text(rng.randrange(8, 60), rng.uniform(0.1, 0.3), rng.randrange(3, 12)), "en", "code") for i in range(800)]
    c = group_counts(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).cache()
    fences = group_fences(c)
    table = {r.g1: r for r in fences.collect()}
    assert all(table["prose"][f"fence_{m}"] != table["code"][f"fence_{m}"] and min(r[f"fence_{m}"] for r in table.values()) > 0 for m in MEASURES)
    gone = lambda f: {r.doc_id for r in verdicts(c, f).where("not kept").collect()}
    own, swapped = gone(fences), gone(fences.withColumn("g1", F.when(F.col("g1") == "prose", "code").otherwise("prose")))
    strays = {i for i in range(0, 800, 20)}
    assert own == strays and not strays & swapped and len([d for d in swapped if d >= 1000]) > 700


def test_secret_scan(spark, sf_dir, rows):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    want = []
    for d, t, *_ in rows:
        found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        n = Counter(x[2] for x in found)
        want.append({"doc_id": d, **{f"n_{k}": n[k] for k in ("assign", "access", "hex")}, "base_sha256": sha(",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found)))})
    same(run(spark, sf_dir, 8), want)


def test_secret_ledger(spark):
    from pyspark.sql import functions as F

    from eralith.llm.secret_scan import VERSIONS, addressed, findings, scanned, secret_scan

    schema = "doc_id long, text string"
    v1 = spark.createDataFrame([(1, "token = abcdefghijkl12"), (2, "nothing"), (3, "token = abcdefghijkl12")], schema)
    found, ledger = secret_scan(v1)
    assert {r.doc_id for r in found.collect() if r.spans} == {1, 3} and ledger.count() == 2
    v2 = spark.createDataFrame([(4, "nothing"), (5, "token = abcdefghijkl12"), (6, "passwd: 1234567890abc")], schema)
    found, ledger = secret_scan(v2, ledger=ledger)
    assert {r.doc_id for r in found.collect() if r.spans} == {5, 6} and ledger.count() == 3
    # a commit adds its rows to those before it and rewrites none
    assert sorted(r["commit"] for r in ledger.collect()) == [1, 1, 2]
    # what the ledger says of a pair that it holds is believed: the blob is not read again
    told = ledger.withColumn("spans", F.array().cast(ledger.schema["spans"].dataType))
    known, _ = secret_scan(spark.createDataFrame([(7, "token = abcdefghijkl12")], schema), ledger=told)
    assert known.first().spans == []
    # one rule at a new version, one added: just these read the blobs of this commit; others keep their rows
    blank = ledger.select("blob", F.map_filter("versions", lambda k, _: k != "hex").alias("versions"), "spans")
    v3 = addressed(spark.createDataFrame([(8, "token = abcdefghijkl12 deadbeefdeadbeef"), (9, "nothing")], schema))
    rules = VERSIONS | {"assign": 2}
    after = scanned(v3, blank, rules)
    got = {r.doc_id: [s.name for s in r.spans] for r in findings(v3, after).collect()}
    assert got == {8: ["assign", "hex"], 9: []}
    versions = [r.versions for r in after.collect()]
    assert len(versions) == 4 and sum(v["assign"] == 2 for v in versions) == 2 and sum("hex" not in v for v in versions) == 2
    # the newest row of a blob counts, and is the one that a further commit asks
    found, longer = secret_scan(v3.select("doc_id", F.col("content").alias("text")), ledger=ledger, rules=rules)
    assert longer.count() == 5 and {r.doc_id: [s.name for s in r.spans] for r in found.collect()} == got
    _, same_again = secret_scan(v3.select("doc_id", F.col("content").alias("text")), ledger=longer, rules=rules)
    assert same_again.count() == 5


def test_packing(spark, sf_dir, rows):
    got = run(spark, sf_dir, 9)
    text, source = {d: t for d, t, *_ in rows}, {d: s for d, _, _, s in rows}
    times, total, bins = Counter(d for d, *_ in rows), Counter(), defaultdict(list)
    for r in got:
        total[r["doc_id"]] += r["n_tokens"] - 1
        bins[r["bin_group"], r["bin"]].append(r)
    assert total == {d: times[d] * len(WORD.findall(t)) for d, t in text.items()} or all(total[d] == times[d] * len(WORD.findall(t)) for d, t in text.items())
    for b in bins.values():
        assert sum(r["n_tokens"] for r in b) + b[0]["residual"] == 2048 and b[0]["residual"] >= 0
        assert len({text[r["doc_id"]] for r in b}) == len(b)
        assert max(Counter(source[r["doc_id"]] for r in b).values()) <= 4


def test_packing_splits_large_groups(spark):
    from eralith.llm.packing import best_fit_packing

    docs = spark.createDataFrame([(1, f"a b c {i % 50}", "s") for i in range(900)] + [(i, "x y", "t") for i in range(2, 100)], "doc_id long, text string, source string")
    got = best_fit_packing(docs, capacity=16, group_pieces=64).collect()
    groups = Counter(r.bin_group for r in got)
    assert len(got) == 998 and max(groups.values()) < 260
    assert all(r.residual >= 0 for r in got)


def test_best_fit_is_tightest():
    import random

    from eralith.llm.packing import best_fit

    rng = random.Random(2)
    n = sorted((rng.randrange(1, 60) for _ in range(300)), reverse=True)
    s, c = [rng.randrange(5) for _ in n], [rng.randrange(150) for _ in n]
    bins = []
    for got, size, source, cluster in zip(best_fit(n, s, c, 100, 2), n, s, c, strict=True):
        fits = [(b["room"], i) for i, b in enumerate(bins) if b["room"] >= size and cluster not in b["c"] and b["s"].count(source) < 2]
        if not fits:
            bins.append({"room": 100, "c": [], "s": []})
        assert got == (min(fits)[1] if fits else len(bins) - 1)
        b = bins[got]
        b["room"] -= size
        b["c"].append(cluster)
        b["s"].append(source)


def test_license_scan(spark, sf_dir, rows):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    want = []
    for d, t, *_ in rows:
        w = word.findall(lower(t))
        at = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        want.append({"doc_id": d, "n_words": len(w), "n_base": len(at), "first_word": min((i for i, _ in at), default=None), "last_word": max((i for i, _ in at), default=None), "base_labels": ",".join(sorted({x for _, x in at}))})
    same(run(spark, sf_dir, 10), want)


def test_license_templates(spark):
    """Every template, its middle alone, two licences in one file, and words of licences that are none."""
    from eralith.llm.license_scan import TEMPLATES, license_scan

    n = len(TEMPLATES)
    middle = lambda t: " ".join(t.split()[len(t.split()) // 4 :])
    docs = [(i, "before " + t.upper() + " after") for i, (_, t) in enumerate(TEMPLATES)] + [(100 + i, middle(t)) for i, (_, t) in enumerate(TEMPLATES)]
    mit, zlib_ = TEMPLATES[0][1], next(t for label, t in TEMPLATES if label == "zlib")
    docs += [(200, "permission to use the license terms of any software is free"), (201, mit[:300] + " some words between " + mit[300:]), (202, mit + " x " * 50 + zlib_ + " y " * 50 + mit)]
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    phrased = {"gpl", "apache"}
    for i, (label, _) in enumerate(TEMPLATES):
        assert label in got[i].labels and got[i].score == 1.0 and {s.label for s in got[i].spans} == {label}, label
        assert set(got[i].labels) <= {label} | phrased
    assert n >= 20 and sum(label in got[100 + i].labels for i, (label, _) in enumerate(TEMPLATES)) >= n - 2
    assert got[200].labels == [] and got[200].score == 0.0 and got[201].labels == ["mit"]
    assert [s.label for s in got[202].spans] == ["mit", "zlib", "mit"] and got[202].spans[0].covered == got[202].spans[2].covered


def test_chains(spark):
    """Chains against all orders of a few matches."""
    import itertools
    import random

    from eralith.llm.license_scan import chains

    rng = random.Random(8)
    for _ in range(60):
        ms = []
        for _ in range(rng.randrange(1, 7)):
            s, n = rng.randrange(40), rng.randrange(3, 8)
            ms.append((s, s + n, rng.randrange(2), rng.randrange(30)))
        ok = lambda a, b: a[2] == b[2] and a[1] <= b[0] and a[3] + a[1] - a[0] <= b[3] and b[0] - a[1] <= 10
        best = max(
            sum(m[1] - m[0] for m in pick)
            for k in range(1, len(ms) + 1) for pick in itertools.permutations(ms, k) if all(ok(a, b) for a, b in zip(pick, pick[1:], strict=False))
        )
        told = chains(ms, 10, 100)
        assert told[0][1] == best
        spans = sorted(x[2:] for x in told)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_automaton_statistics():
    """Matches against all pairs of runs."""
    import random

    from eralith.llm.license_scan import SuffixAutomaton

    rng = random.Random(4)
    seqs = [[rng.choice("abc") for _ in range(rng.randrange(5, 25))] for _ in range(4)]
    a = SuffixAutomaton(seqs)
    runs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for _ in range(200):
        t = [rng.choice("abcd") for _ in range(30)]
        for s, e, state in a.matches(t, 3):
            assert tuple(t[s:e]) in runs and (e == len(t) or tuple(t[s : e + 1]) not in runs) and (s == 0 or tuple(t[s - 1 : e]) not in runs)
            assert a.ends[state] == {(k, i + e - s - 1) for k, q in enumerate(seqs) for i in range(len(q)) if q[i : i + e - s] == t[s:e]}


@pytest.mark.parametrize("n", range(1, 11))
def test_empty_table(spark, empty_dir, sf_dir, n):
    name = next(k for k in QUERIES if k.startswith(f"op{n}_"))
    df = QUERIES[name](spark, empty_dir)
    assert df.collect() == [] and df.columns == QUERIES[name](spark, sf_dir).columns


@pytest.mark.parametrize("n", range(1, 11))
def test_clashing_columns(spark, tmp_path, n):
    """Further columns may have the names that operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "a b c d e f g h i j k l m", "en", "s"), (2, None, None, None)], "doc_id long, text string, lang string, source string")
    more = {c: F.lit(7) for c in "doc sig sig2 at h n items root node kind block ref m0 k0 spans blob content n_words kept".split()}
    df.withColumns(more).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"] for r in run(spark, str(tmp_path), n)} == {1, 2}


def test_radix_equal():
    """Equal strings of each group against all pairs."""
    import random

    import numpy as np

    from eralith.llm.suffix_dedup import radix_equal

    rng = random.Random(6)
    for length in (8, 13, 64, 70):
        pieces = ["".join(rng.choice("abc") for _ in range(rng.randrange(40, 200))) for _ in range(6)]
        data = "".join(rng.choice(pieces) for _ in range(60))[:3000] + "\0" * 8
        start = sorted(rng.sample(range(2900), 700))
        group = np.sort(np.array([rng.randrange(5) for _ in start]))
        got = radix_equal(np.frombuffer(data.encode(), np.uint8), np.array(start), group, length)
        count = Counter((g, data[s : s + length]) for g, s in zip(group, start, strict=True))
        assert got.tolist() == [count[g, data[s : s + length]] > 1 for g, s in zip(group, start, strict=True)] and got.any()


def test_suffix_dedup_large_groups(spark, monkeypatch):
    """A passage with many surroundings: the same with groups that are held and with groups that are too large for it."""
    import random

    from eralith.llm import suffix_dedup

    rng = random.Random(7)
    letters = lambda n: "".join(rng.choice("abcdefghij klmn") for _ in range(n))
    passage = letters(900)
    docs = [(i, letters(rng.randrange(0, 300)) + passage[rng.randrange(200) : 900 - rng.randrange(200)] + letters(rng.randrange(0, 300))) for i in range(80)] + [(900, "z" * 1500), (901, letters(500))]
    count = Counter(t[i : i + 400] for _, t in docs for i in range(len(t) - 399))
    want = {}
    for d, t in docs:
        gone = {j for i in range(len(t) - 399) if count[t[i : i + 400]] > 1 for j in range(i, i + 400)}
        want[d] = (len(gone), "".join(x for j, x in enumerate(t) if j not in gone).encode())
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for most in (suffix_dedup.MOST_HELD, 3000):
        monkeypatch.setattr(suffix_dedup, "MOST_HELD", most)
        got = {r.doc_id: (r.n_removed, bytes(r.kept)) for r in suffix_dedup.repeated_spans(df).collect()}
        assert got == want, most


def test_suffix_dedup_common_passage(spark, monkeypatch):
    """A passage of every text sends two rows a slice to the task of one key, not one a text."""
    import random

    from eralith.llm import suffix_dedup

    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdefghij klmn") for _ in range(n))
    passage = letters(450)
    docs = [(i, letters(rng.randrange(1, 60)) + passage + letters(rng.randrange(1, 60)) + letters(40) * 14 * (i % 9 == 0)) for i in range(300)] + [(900, letters(500))]
    count = Counter(t[i : i + 400] for _, t in docs for i in range(len(t) - 399))
    want = {}
    for d, t in docs:
        gone = {j for i in range(len(t) - 399) if count[t[i : i + 400]] > 1 for j in range(i, i + 400)}
        want[d] = (len(gone), "".join(x for j, x in enumerate(t) if j not in gone).encode())
    dealt = []

    def told(df, *args, **more):
        dealt.append(df.groupBy("h", "h2").count().agg({"count": "max"}).first()[0])
        return shared_runs(df, *args, **more)

    shared_runs = suffix_dedup.shared_runs
    monkeypatch.setattr(suffix_dedup, "shared_runs", told)
    monkeypatch.setattr(suffix_dedup, "MOST_HELD", 3000)
    got = {r.doc_id: (r.n_removed, bytes(r.kept)) for r in suffix_dedup.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got == want
    assert 2 <= dealt[0] <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions")) < 100


def test_thinned():
    """A key of many texts sends two rows of a slice to its task; what is known of the others is true."""
    import numpy as np

    from eralith.llm._text import thinned

    key = np.array([7] * 6 + [8, 8, 9] + [5] * 4)
    sig = np.array([1, 2, 3, 4, 4, 5] + [1, 1, 2] + [1, 2, 1, 2])
    doc = np.array([10, 20, 30, 41, 40, 50] + [10, 11, 20] + [10, 20, 11, 21])
    rows, dealt, known = thinned(key, sig, doc)
    assert sorted(zip(key[rows].tolist(), doc[rows].tolist(), strict=True)) == [(5, 10), (5, 20), (7, 10), (7, 20), (7, 30), (7, 40), (7, 50), (8, 10), (9, 20)]
    assert sorted(key[rows][known].tolist()) == [7, 7, 7] and (dealt[~known] == key[rows][~known]).all()
    assert not set(dealt[known]) & set(key.tolist()) and len(set(dealt[known])) == 3
