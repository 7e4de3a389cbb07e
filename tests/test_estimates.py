"""Large-scale characteristics by bits, competing causes and Poisson limits against plain versions."""

import datetime as dt
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from eralith.operators import characterise as ch
from eralith.operators import incidence as ic
from eralith.operators import survival as su

DAY = dt.date(2003, 5, 1)
COHORT = "cohort_definition_id long, subject_id long, cohort_start_date date"


def day(n):
    return DAY + dt.timedelta(n)


@pytest.mark.parametrize("n_windows", [3, 70])
def test_large_scale_by_bits(spark, n_windows):
    """Repeated entries and events, entries of one subject, more windows than one number has bits; no row is expanded."""
    rng = random.Random(n_windows)
    entries = [(rng.choice([1, 2]), rng.randrange(12), day(rng.randrange(100))) for _ in range(40)]
    entries += entries[:3]
    events = [(rng.randrange(14), rng.choice([7, 8, None]), day(s := rng.randrange(100)), day(s + rng.randrange(9))) for _ in range(150)]
    windows = [(None, -1), (0, 0), (1, None), *((k - 40, k - 38) for k in range(n_windows - 3))]
    d = ch.large_scale(spark.createDataFrame(entries, COHORT), spark.createDataFrame(events, "person_id long, concept_id long, start_date date, end_date date"), windows)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan
    want, total = Counter(), Counter(c for c, _, _ in entries)
    for c, p, i in set(entries):
        for lo, hi in windows:
            for k in {k for q, k, s, e in events if q == p and k and (lo is None or e >= i + dt.timedelta(lo)) and (hi is None or s <= i + dt.timedelta(hi))}:
                want[c, f"{'-inf' if lo is None else lo} to {'inf' if hi is None else hi}", k] += 1
    got = {(r.cohort_definition_id, r.window, r.concept_id): (r["count"], r.percentage) for r in d.collect()}
    assert got == {k: (n, pytest.approx(n * 100 / total[k[0]])) for k, n in want.items()}


def test_causes_add_up(spark):
    """Three causes and survival add up to 1 at all times, also when all at risk have an event; variances by their definition."""
    rng = random.Random(6)
    rows = [(g, rng.randrange(1, 30), rng.choice(["x", "y", "z", None])) for g in (1, 2) for _ in range(90)] + [(3, 5, "x"), (3, 5, "y"), (4, 2, None), (5, None, None)]
    d = su.cause_incidence(spark.createDataFrame(rows, "cohort_definition_id long, time int, cause string"), ["x", "y", "z"]).collect()
    by = {}
    for r in d:
        by.setdefault((r.cohort_definition_id, r.time), {})[r.cause] = r
    assert {g for g, _ in by} == {1, 2, 3, 4}
    for (g, t), causes in by.items():
        assert sum(r.cumulative_incidence for r in causes.values()) + causes["x"].survival == pytest.approx(1, abs=1e-12)
        at, s, f = [], 1.0, dict.fromkeys("xyz", 0.0)
        for u in sorted({v for h, v, _ in rows if h == g and v <= t}):
            n = sum(h == g and v >= u for h, v, _ in rows)
            k = Counter(c for h, v, c in rows if h == g and v == u and c)
            for c in "xyz":
                f[c] += s * k[c] / n
            at.append((u, n, k, s, dict(f)))
            s *= 1 - k.total() / n
        for c, r in causes.items():
            v = sum(
                ((f[c] - fi[c]) ** 2 * k.total() / (n * (n - k.total())) if k.total() < n else 0) + si**2 * (n - k[c]) * k[c] / n**3 - 2 * (f[c] - fi[c]) * si * k[c] / n**2
                for _, n, k, si, fi in at
            )
            assert (r.n_risk, r.n_events, r.cumulative_incidence, r.variance) == (at[-1][1], at[-1][2][c], pytest.approx(f[c]), pytest.approx(max(v, 0), abs=1e-12))


def test_first_cause(spark):
    """The earliest event; of one day the cause named first; nothing where any event lies in its washout."""
    rows = [(1, 9, 0, 4, 1, 9, 0), (2, 4, 1, 4, 1, 9, 0), (3, 9, 0, 9, 0, 9, 0), (4, None, None, 4, 1, 9, 0), (5, 3, 1, 4, 1, 2, 1)]
    df = spark.createDataFrame(rows, "id int, a_time int, a_status int, b_time int, b_status int, c_time int, c_status int")
    got = {r.id: (r.time, r.cause) for r in su.first_cause(df, {"b": "b_", "a": "a_", "c": "c_"}).collect()}
    assert got == {1: (4, "b"), 2: (4, "b"), 3: (9, None), 4: (None, None), 5: (2, "c")}
    assert [r.cause for r in su.first_cause(df, {"a": "a_"}).orderBy("id").collect()] == [None, "a", None, None, "a"]


def test_poisson_limits(spark):
    """The tails at the limits are 2.5 % each, from no event to hundreds of thousands; nothing runs in Python."""
    counts = [0, 1, 2, 5, 10, 99, 1000, 12345, 400_000]
    df = spark.createDataFrame([(float(k), 100_000.0) for k in counts], "n double, years double")
    d = df.select("n", ic.poisson_limits(F.col("n"), F.col("years")).alias("x")).select("n", "x.*")
    assert "Python" not in d._jdf.queryExecution().executedPlan().toString()

    def up_to(k, m):
        """Probability of k or fewer at mean m, from the greatest term outwards."""
        term, total, j = math.exp(k * math.log(m) - m - math.lgamma(k + 1)), 0.0, k
        while j >= 0 and term > 1e-18:
            total += term
            term *= j / m
            j -= 1
        return total

    for r in d.collect():
        k = int(r.n)
        assert up_to(k, r.upper) == pytest.approx(0.025, rel=1e-6)
        assert r.lower == 0 if k == 0 else up_to(k - 1, r.lower) == pytest.approx(0.975, rel=1e-6)
    g = spark.createDataFrame([(x,) for x in (0.5, 1.0, 7.25, 500.0, 1e6)], "a double").select("a", ic.log_gamma(F.col("a")).alias("g")).collect()
    assert all(r.g == pytest.approx(math.lgamma(r.a), rel=1e-12, abs=1e-12) for r in g)
