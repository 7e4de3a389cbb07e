"""Treatment pathways against a plain version that parts two overlapping rows at a time."""

import datetime as dt
import random

import pytest

from eralith.operators import pathways as pa

DAY = dt.date(2001, 1, 1)
COHORT = "cohort_definition_id long, subject_id long, cohort_start_date date, cohort_end_date date"


def parted(rows, window, keep):
    """Steps of eras (start, end, (treatment,)), by rewriting the first overlap of two neighbours until there is none."""
    rows, i = sorted(rows), 0
    while i + 1 < len(rows):
        (s1, e1, a), (s2, e2, b) = rows[i], rows[i + 1]
        both = tuple(sorted({*a, *b}))
        switch = (min(e1, e2) - s2).days < window or both in (a, b)
        if s2 >= e1 or (switch and keep):
            i += 1
            continue
        if switch:
            new = [(s1, s2, a), (s2, max(e1, e2) if both == b else e2, b)]
        else:
            new = [(s1, s2, a), (s2, min(e1, e2), both), (min(e1, e2), max(e1, e2), b if e1 <= e2 else a)]
        rows[i : i + 2] = [r for r in new if r[1] > r[0]]
        rows.sort()
        i = max(i - 1, 0)
    return rows


@pytest.mark.parametrize("overlap", ["truncate", "keep"])
@pytest.mark.parametrize("window", [0, 5, 30])
def test_random_histories(spark, overlap, window):
    rng = random.Random(window)
    names, events, eras = dict(enumerate("abcde", 1)), [], {}
    for person in range(120):
        for k in range(1, 6):
            at = 0
            for _ in range(rng.choice([0, 1, 1, 3])):  # eras of one treatment lie more than the gap apart
                at += 2 + rng.randrange(40)
                end = at + rng.choice([0, 1, 7, 60])
                events.append((k, person, DAY + dt.timedelta(at), DAY + dt.timedelta(end)))
                eras.setdefault(person, []).append((DAY + dt.timedelta(at), DAY + dt.timedelta(end), (names[k],)))
                at = end
    target = spark.createDataFrame([(1, p, DAY, DAY + dt.timedelta(10_000)) for p in range(120)], COHORT)
    df = spark.createDataFrame(events, COHORT)
    for kind in ("all", "first", "changes"):
        history = pa.treatment_history(target, df, names, era_gap=0, combination_window=window, filter_treatments=kind, overlap=overlap)
        got = {}
        for r in sorted(history.collect(), key=lambda r: (r.person_id, r.sequence)):
            got.setdefault(r.person_id, []).append((r.start_date, r.end_date, tuple(r.treatments)))
            assert r.sequence == len(got[r.person_id])
        for person, mine in eras.items():
            steps = parted(mine, window, overlap == "keep")
            kept = []
            for x in steps:
                if kind == "all" or x[2] not in ({y[2] for y in kept} if kind == "first" else {y[2] for y in kept[-1:]}):
                    kept.append(x)
            assert got[person] == kept, (person, mine)
        assert set(got) == set(eras)


def test_plan_and_edges(spark):
    """No Python in the plan; no events, events outside the entry and unknown cohorts give no steps."""
    target = spark.createDataFrame([(1, 1, DAY, DAY + dt.timedelta(10)), (1, 2, DAY, DAY)], COHORT)
    events = spark.createDataFrame([(1, 1, DAY + dt.timedelta(11), DAY + dt.timedelta(20)), (1, 1, DAY + dt.timedelta(3), DAY + dt.timedelta(90))], COHORT)
    d = pa.treatment_history(target, events, {1: "a"})
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan and "Pandas" not in plan
    assert [tuple(r) for r in d.collect()] == [(1, 1, ["a"], DAY + dt.timedelta(3), DAY + dt.timedelta(10))]
    assert pa.treatment_history(target, events.where("false"), {1: "a"}).collect() == []
    with pytest.raises(ValueError, match="overlap"):
        pa.treatment_history(target, events, {1: "a"}, overlap="other")
