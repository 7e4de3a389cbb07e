"""Sweeps, strict time at risk and tables laid out by person, against plain versions and their plans."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from eralith.functions.sweeps import overlap_totals, point, points, segments
from eralith.operators.enrich import add_intersect
from eralith.operators.incidence import incidence, strict_incidence, time_at_risk
from eralith.sources import layout as la

DAY = dt.date(2000, 1, 1)


def day(n):
    return DAY + dt.timedelta(n)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """Joins as they are for tables of any size."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


EVENTS, ENTRIES = "person_id long, start_date date, end_date date, extra int", "subject_id long, cohort_start_date date, start int"


def test_overlap_totals(spark):
    """Counts and first dates of many windows against all pairs, with ties, nulls, repeats and persons on one side alone."""
    rng = random.Random(4)
    events = [(rng.choice([1, 2, 3, 4, None]), s := rng.choice([day(rng.randrange(60)), None]), None if s is None or rng.random() < 0.2 else s + dt.timedelta(rng.choice([0, 0, 3, 40])), 1) for _ in range(300)]
    entries = [(rng.choice([1, 2, 3, 9, None]), rng.choice([day(rng.randrange(60)), None]), 1) for _ in range(80)] + [(1, day(5), 1)] * 2
    windows = [(-5, 5), (0, 0), (None, -1), (1, None), (None, None), (-30, -10), (10, 20)]
    got = add_intersect(spark.createDataFrame(entries, ENTRIES), spark.createDataFrame(events, EVENTS), windows, name="e")
    label = lambda w: "_".join("minf" if v is None and k == 0 else "inf" if v is None else f"m{-v}" if v < 0 else str(v) for k, v in enumerate(w))
    rows = got.collect()
    assert Counter((r.subject_id, r.cohort_start_date, r.start) for r in rows) == Counter(entries)
    for r in rows:
        for w in windows:
            i, mine = r.cohort_start_date, []
            for p, s, e, _ in events:
                if None not in (p, s, i) and p == r.subject_id:
                    e = s if e is None else e
                    if (w[0] is None or e >= i + dt.timedelta(w[0])) and (w[1] is None or s <= i + dt.timedelta(w[1])):
                        mine.append(s)
            k = label(w)
            want = (len(mine), int(bool(mine)), min(mine, default=None), (min(mine) - i).days if mine else None)
            assert tuple(r[f"e_{x}_{k}"] for x in ("count", "flag", "date", "days")) == want, (r, w)
    with pytest.raises(ValueError, match="before it begins"):
        overlap_totals(spark.createDataFrame(entries, ENTRIES), spark.createDataFrame(events, EVENTS), [(2, 1)], "subject_id", "cohort_start_date")


def test_heavy_person(spark):
    """A person with 100,000 events and 10,000 entries: no more rows than days and questions go through the sweep, rows as from the days themselves."""
    ids = spark.range(10_000).selectExpr("1L as subject_id", "date_add(date'1990-01-01', cast(id as int)) as cohort_start_date")
    events = spark.range(100_000).selectExpr("1L as person_id", "date_add(date'1990-01-01', cast(id * 7919 % 10000 as int)) as start_date", "date_add(date'1990-01-01', cast(id * 7919 % 10000 + id % 5 as int)) as end_date")
    got = add_intersect(ids, events, [(-30, -1), (0, None)], name="e").collect()
    starts, first = Counter(), dt.date(1990, 1, 1)
    both = [(k * 7919 % 10_000, k * 7919 % 10_000 + k % 5) for k in range(100_000)]
    until, before = [0] * 10_040, [0] * 10_040
    for s, e in both:
        starts[s] += 1
        before[e + 1] += 1
    for d in range(10_040):
        until[d] = starts[d] + (until[d - 1] if d else 0)
        before[d] += before[d - 1] if d else 0
    for r in got:
        i = (r.cohort_start_date - first).days
        assert r.e_count_m30_m1 == (until[i - 1] if i else 0) - before[max(i - 30, 0)] and r.e_count_0_inf == 100_000 - before[i]
    assert len(got) == 10_000 and sum(r.e_count_m30_m1 for r in got) > 2_000_000


def test_no_entry_meets_an_event(spark, no_broadcast):
    """Joins are on keys alone, and the sweep's joins have a person's days on one side at most."""
    ids = spark.createDataFrame([(1, day(0), 1)], ENTRIES)
    d = overlap_totals(ids, spark.createDataFrame([(1, day(0), day(1), 1)], "subject_id long, start date, end date, x int"), [(0, 5)], "subject_id", "cohort_start_date")
    p = plan(d)
    assert "LeftSemi" in p and "Inner" not in p and "NestedLoop" not in p


def test_segments(spark):
    df = spark.createDataFrame([("a", day(0), day(9)), ("a", day(5), day(9)), ("b", day(3), day(3)), ("a", None, None)], "k string, s date, e date")
    pts = points(df, ["k"], point(F.col("s"), n=1), point(F.date_add("e", 1), n=-1))
    got = sorted((r.k, r.start, r.end, r.n) for r in segments(pts, ["k"], ["n"]).collect())
    assert got == [("a", day(0), day(4), 1), ("a", day(5), day(9), 2), ("b", day(3), day(3), 1)]


COHORT = "cohort_definition_id long, subject_id long, cohort_start_date date, cohort_end_date date"


def test_time_at_risk(spark):
    """Stretches against person-days, with overlapping denominators, outcomes before, inside, nested and touching, for all modes."""
    rng = random.Random(9)
    span = lambda n, longest: [(rng.choice([1, 2]), rng.randrange(8), day(s := rng.randrange(100)), day(s + rng.randrange(longest))) for _ in range(n)]
    den, out = span(14, 60), [(1, p, s, rng.choice([e, None])) for _, p, s, e in span(20, 12)]
    d, o = spark.createDataFrame(den, COHORT), spark.createDataFrame(out, COHORT)
    for washout, repeated in ((None, False), (None, True), (0, True), (5, True), (5, False)):
        rows = time_at_risk(d, o, washout, repeated).collect()
        got = Counter()
        for r in rows:
            n = (r.cohort_end_date - r.cohort_start_date).days + 1
            assert n >= 1 and (r.n_events == 0 or n == 1)
            got.update((r.cohort_definition_id, r.subject_id, r.cohort_start_date + dt.timedelta(k), r.n_events) for k in range(n))
        want = Counter()
        for key in {x[:2] for x in den}:
            days = sorted({s + dt.timedelta(k) for *x, s, e in den if tuple(x) == key for k in range((e - s).days + 1)})
            mine, done = [(s, max(s, e or s)) for _, p, s, e in out if p == key[1]], False
            for t in days:
                if done or any(t > s and (washout is None or t <= e + dt.timedelta(washout)) for s, e in mine):
                    continue
                event = any(s == t for s, _ in mine)
                want[(*key, t, int(event))] += 1
                done = event and not repeated
        assert got == want, (washout, repeated)


def test_strict_and_default_rates(spark):
    """Without any outcome both modes agree on persons and days; an overall interval spans a cohort's time."""
    den = spark.createDataFrame([(1, 1, day(0), day(399)), (1, 2, day(50), day(60)), (2, 1, day(10), day(20))], COHORT)
    none = spark.createDataFrame([], COHORT)
    for interval in ("years", "months", "overall"):
        a, b = (sorted(map(tuple, f(den, none, interval=interval).collect())) for f in (incidence, strict_incidence))
        assert a == b and a
    one = spark.createDataFrame([(1, 1, day(100), day(100))], COHORT)
    r = {(x.cohort_definition_id): x for x in strict_incidence(den, one, interval="overall").collect()}
    assert (r[1].interval_start, r[1].interval_end, r[1].n_persons, r[1].person_days, r[1].n_events) == (day(0), day(399), 2, 112, 1) and r[2].n_events == 0


@pytest.fixture
def database(spark, tmp_path):
    spark.sql(f"CREATE DATABASE laid LOCATION '{tmp_path}/laid'")
    yield "laid"
    spark.sql("DROP DATABASE laid CASCADE")


def test_tables_by_person_meet_without_a_shuffle(spark, database, no_broadcast):
    """Target, events and observation periods join, and are counted by person, where they lie; also after a batch was appended."""
    target = spark.range(300).selectExpr("1L as cohort_definition_id", "id as subject_id", "date'2000-01-01' as cohort_start_date")
    events = spark.range(2000).selectExpr("id % 400 as person_id", "date_add(date'2000-01-01', cast(id % 90 as int)) as start_date", "id")
    op = spark.range(400).selectExpr("id as person_id", "date'1999-01-01' as s", "date'2001-01-01' as e")
    t, o = (la.lay_out(x, f"{database}.{n}", 6) for n, x in (("target", target), ("op", op)))
    la.lay_out(events.where("id % 2 = 0"), f"{database}.events", 6)
    e = la.append_batch(events.where("id % 2 = 1"), f"{database}.events", "it's")

    def counted(t, e, o):
        d = t.join(e, t["subject_id"] == e["person_id"]).join(o, t["subject_id"] == o["person_id"])
        return d.where("start_date between s and e").groupBy("subject_id").agg(F.count("*").alias("n"))

    laid, plain = counted(t, e, o), counted(target, events, op)
    assert "Exchange" not in plan(laid) and plan(laid).count("SortMergeJoin") == 2 and plan(plain).count("Exchange") >= 3
    assert sorted(laid.collect()) == sorted(plain.collect())


def test_batches_count_once(spark, database):
    """A batch that is appended again replaces itself; other batches stay; columns go by name; extra columns are left out."""
    name = f"{database}.events"
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "person_id long, v string")
    assert sorted(la.lay_out(df, name, 4).select("person_id", "v").collect(), key=str) == sorted(df.collect(), key=str)
    more = spark.createDataFrame([("x", 5, 7), ("y", 1, 7)], "v string, person_id long, other int")
    for _ in range(2):
        la.append_batch(more, name, "more")
    assert spark.table(name).count() == 5 and la.batches(spark, name) == ["first", "more"]
    la.append_batch(more.where("v = 'x'"), name, "more")
    assert sorted(r.v for r in spark.table(name).collect()) == ["a", "b", "c", "x"]
    la.append_batch(more.where("false"), name, "more")
    assert spark.table(name).count() == 3
    assert la.layout_of(spark, name) == ("person_id", 4)
    with pytest.raises(ValueError, match="person_id"):
        la.append_batch(more.drop("person_id"), name, "less")
    with pytest.raises(ValueError, match="one of"):
        la.lay_out(more.drop("person_id"), f"{database}.none")
    spark.range(3).write.saveAsTable(f"{database}.plain")
    with pytest.raises(ValueError, match="laid out"):
        la.layout_of(spark, f"{database}.plain")


def test_container_by_person(spark, database, tmp_path):
    from eralith.sources.clinical import Clinical

    c = Clinical({"person": spark.range(9).withColumnRenamed("id", "person_id"), "concept": spark.range(3)}, {"t": spark.range(4).withColumnRenamed("id", "subject_id")})
    laid = la.lay_out_clinical(c, f"{database}.x_", 3, path=f"{tmp_path}/files")
    assert {n: laid[n].count() for n in ("person", "concept", "t")} == {"person": 9, "concept": 3, "t": 4}
    assert la.layout_of(spark, f"{database}.x_t") == ("subject_id", 3) and laid["concept"] is c["concept"] and laid["person"].columns == ["person_id"]


def test_temporary(spark):
    df = spark.range(5).selectExpr("id", "rand() as x")
    kept = la.temporary(df)
    assert kept.dtypes == df.dtypes and kept.collect() == kept.collect()


def test_dose_eras(spark):
    """Concurrent doses add up, equal doses over a short gap are one era, another dose or a longer gap begins one; by days."""
    from eralith.operators.dose import dose_eras
    from eralith.sources.clinical import Clinical

    rng = random.Random(2)
    strength = [(d, 100 + d % 2, v, 8576, None, None, None, None) for d, v in ((1, 10.0), (2, 5.0), (3, 0.1), (4, None))]
    schema = "drug_concept_id long, ingredient_concept_id long, amount_value double, amount_unit_concept_id int, numerator_value double, numerator_unit_concept_id int, denominator_value double, denominator_unit_concept_id int"
    drugs = []
    for _ in range(150):
        s, n = rng.randrange(200), rng.choice([1, 3, 10])
        drugs.append((rng.randrange(6), rng.choice([1, 2, 3, 4, 9]), float(rng.choice([n, 2 * n, 0])), day(s), rng.choice([day(s + n - 1)] * 5 + [None, day(s - 2)])))
    drugs.append((None, 1, 1.0, day(0), day(0)))
    c = Clinical({"drug_strength": spark.createDataFrame(strength, schema), "drug_exposure": spark.createDataFrame(drugs, "person_id long, drug_concept_id long, quantity double, drug_exposure_start_date date, drug_exposure_end_date date")})
    value, taken = {r[0]: (r[1], r[2]) for r in strength}, {}
    for p, d, q, s, e in drugs:
        if p is None or value.get(d, (0, None))[1] is None or not q:
            continue
        e = max(s, e or s)
        days = (e - s).days + 1
        for k in range(days):
            at = taken.setdefault((p, value[d][0]), {})
            at[s + dt.timedelta(k)] = round(at.get(s + dt.timedelta(k), 0) + round(value[d][1] * q / days, 6), 6)
    for gap in (0, 30):
        want = set()
        for key, at in taken.items():
            run = []
            for t in sorted(at):
                if run and (at[t] != at[run[-1]] or (t - run[-1]).days > gap + 1):
                    want.add((*key, at[run[0]], run[0], run[-1]))
                    run = []
                run.append(t)
            want.add((*key, at[run[0]], run[0], run[-1]))
        rows = dose_eras(c, gap).collect()
        got = {(r.person_id, r.drug_concept_id, round(r.dose_value, 6), r.dose_era_start_date, r.dose_era_end_date) for r in rows}
        assert got == want and len(rows) == len(got) and {r.unit_concept_id for r in rows} == {8576}


def test_indication(spark):
    """Names of the cohorts that meet a window, against all pairs; ties, repeats, unknown cohorts, nulls and empty cohorts."""
    from eralith.operators.drug import indication

    rng = random.Random(12)
    entries = [(1, rng.choice([*range(9), None]), day(rng.randrange(60))) for _ in range(40)] * 2
    other = [(rng.choice([1, 2, 3, 7]), rng.choice([*range(9), None]), day(s := rng.randrange(60)), day(s + rng.choice([0, 5]))) for _ in range(80)]
    names = {1: "one", 2: "two", 3: "one more"}
    df, cohorts = spark.createDataFrame(entries, "cohort_definition_id long, subject_id long, cohort_start_date date"), spark.createDataFrame(other, COHORT)
    for lo, hi in ((-10, 0), (0, None), (None, -5)):
        want = Counter()
        for e in entries:
            met = {names[c] for c, p, s, t in other if c in names and p is not None and p == e[1] and (lo is None or t >= e[2] + dt.timedelta(lo)) and (hi is None or s <= e[2] + dt.timedelta(hi))}
            want[(*e, " and ".join(sorted(met)) or "unknown")] += 1
        got = Counter((r.cohort_definition_id, r.subject_id, r.cohort_start_date, r.indication) for r in indication(df, cohorts, names, (lo, hi)).collect())
        assert got == want
    assert {r.indication for r in indication(df, cohorts.where("false"), names, (0, 0)).collect()} == {"unknown"}
