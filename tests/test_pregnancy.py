"""Pregnancy episodes against a plain Python version on random records."""

import datetime as dt
import random

from eralith.operators import pregnancy as pr


def day(n):
    return dt.date(2015, 1, 1) + dt.timedelta(n)


def test_outcomes_and_timing(spark):
    rng = random.Random(6)
    kinds = ["LB", "SB", "AB", "SA", "DELIV", "ECT", "GEST", None]
    rows = sorted({(p, day(rng.randrange(2500))): rng.choice(kinds) for p in range(40) for _ in range(14)}.items(), key=str)
    rows = [(p, d, k) for (p, d), k in rows]
    got = {(r.person_id, r.episode_start_date, r.episode_end_date, r.category, r.n_records) for r in pr.outcome_episodes(spark.createDataFrame(rows, "person_id long, record_date date, category string")).collect()}
    want = set()
    for p in range(40):
        mine, eps, last = [(d, k) for q, d, k in rows if q == p], [], None
        for d, k in sorted(((d, k) for d, k in mine if k in pr.LONGEST_TERM), reverse=True):
            if last is None or (last[0] - d).days >= pr.SPACING[(k in pr.LATE) + (last[1] in pr.LATE)]:
                eps.append((d - dt.timedelta(pr.LONGEST_TERM[k]), d, k, 1))
                last = (d, k)
        group = []
        for d in sorted(d for d, k in mine if k not in pr.LONGEST_TERM and not any(a <= d <= b for a, b, *_ in eps)):
            if group and (d - group[0]).days <= 305:
                group.append(d)
            else:
                want |= {(p, group[0], group[-1], "PREG", len(group))} if group else set()
                group = [d]
        want |= {(p, group[0], group[-1], "PREG", len(group))} if group else set()
        want |= {(p, *e) for e in eps}
    assert got == want

    timed = [(p, d, rng.choice([1, 4, 7, None]), rng.choice([3, 6, 9])) for p, d, _ in rows]
    got = {(r.person_id, r.episode_start_date, r.episode_end_date, r.n_records) for r in pr.timing_episodes(spark.createDataFrame(timed, "person_id long, record_date date, min_month int, max_month int")).collect()}
    want = set()
    for p in range(40):
        eps = []
        for _, d, lo, hi in sorted((x for x in timed if x[0] == p), key=lambda x: x[1]):
            if eps:
                s, e, n = eps[-1]
                gap, m = (d - e).days, (d - s).days / 30
                agrees = lo is None or lo - 2 <= m <= hi + 2
                if gap <= 300 and (agrees or gap <= 30):
                    eps[-1] = (s, d, n + 1)
                    continue
            eps.append((d, d, 1))
        want |= {(p, *e) for e in eps if (e[1] - e[0]).days <= 365}
    assert got == want


def test_merge(spark):
    schema = "person_id long, episode_id long, episode_start_date date, episode_end_date date, category string, outcome_date date, n_records long"
    hip = spark.createDataFrame([(1, 1, day(0), day(300), "LB", day(300), 1), (1, 2, day(600), day(700), "SA", day(700), 1)], schema)
    pps = spark.createDataFrame([(1, 1, day(10), day(290), "PREG", None, 4), (1, 2, day(280), day(305), "PREG", None, 2), (2, 1, day(5), day(9), "PREG", None, 1)], schema)
    got = sorted((r.person_id, r.source, r.episode_start_date, r.episode_end_date, r.n_records) for r in pr.merge_episodes(hip, pps).collect())
    assert got == [(1, "HIP", day(600), day(700), 0), (1, "HIP+PPS", day(0), day(305), 2), (1, "PPS", day(10), day(290), 4), (2, "PPS", day(5), day(9), 1)]
    v = pr.validate_episodes(pps).first()
    assert (v.n_episodes, v.n_overlapping, v.n_inverted, v.n_long) == (3, 1, 0, 0)
