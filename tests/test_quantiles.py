"""Exact quantiles against sorted lists, and their plans."""

import math
import random

import pytest
from pyspark.sql import functions as F

from eralith.functions.quantiles import at_ranks, bucket, interpolated, lowest_at, nearest_index
from eralith.operators import characterise as ch
from eralith.operators import drug_checks as dc
from eralith.operators import pathways as pa

SHARES = (0.0, 0.05, 0.25, 0.5, 0.9, 1.0)


@pytest.fixture(scope="module")
def groups():
    rng = random.Random(3)
    out = {
        None: [rng.uniform(-1e-3, 1e3) for _ in range(101)], "ties": [rng.choice([-2.0, 0.0, 0.0, 7.5]) for _ in range(60)], "one": [4.25], "narrow": [1e6 + k / 7 for k in range(500)],
        "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(300)] + [float("inf"), float("-inf"), 5e-324], "none": [None, None],
    }
    for v in out.values():
        rng.shuffle(v)
    return out


def test_ranks(spark, groups):
    df = spark.createDataFrame([(g, v) for g, x in groups.items() for v in [*x, None]], "g string, v double").repartition(5)
    d = at_ranks(df, ["g"], "v", {f"{f.__name__}{i}": f(q) for i, q in enumerate(SHARES) for f in (lowest_at, nearest_index)} | {"beyond": F.col("_of") + 1})
    got = {r.g: r for r in d.collect()}
    assert set(got) == {g for g in groups if g != "none"}
    for g, r in got.items():
        x = sorted(v for v in groups[g] if v is not None)
        assert r["_of"] == len(x) and r["beyond"] is None
        for i, q in enumerate(SHARES):
            assert r[f"lowest_at{i}"] == x[max(math.ceil(q * len(x)), 1) - 1]
            assert r[f"nearest_index{i}"] == x[math.floor((len(x) - 1) * q + 0.5)]
    # the same values as by an aggregate that holds all of them
    names = {f"i{i}": q for i, q in enumerate(SHARES)}
    mine = {r.g: r for r in interpolated(df.where("g != 'wide' or g is null"), ["g"], "v", names).collect()}
    for r in df.where("g != 'wide' or g is null").groupBy("g").agg(*(F.percentile("v", F.lit(q)).alias(n) for n, q in names.items())).collect():
        assert r.g == "none" or all(mine[r.g][n] == pytest.approx(r[n], rel=1e-12) for n in names)


def test_buckets_follow_values(spark):
    values = sorted([0.0, float("inf"), float("-inf"), 5e-324, 1.7e308, *(s * 2.0**k * m for s in (-1, 1) for k in range(-1060, 1020, 37) for m in (1, 1.001, 1.5))])
    got = [r.b for r in spark.createDataFrame([(i, v) for i, v in enumerate([*values, float("nan")])], "i int, v double").select("i", bucket(F.col("v")).alias("b")).orderBy("i").collect()]
    assert got == sorted(got) and len(set(got)) > len(values) * 0.6


def test_summaries_keep_no_group_in_a_buffer(spark, groups):
    df = spark.createDataFrame([(g, v, 1) for g, x in groups.items() if g != "wide" for v in x], "g string, v double, person_id int")
    history = df.selectExpr("person_id", "1L as sequence", "array(coalesce(g, 'x')) as treatments", "date'2000-01-01' as start_date", "date_add(date'2000-01-01', cast(coalesce(v, 0) as int) % 50) as end_date")
    records = df.selectExpr("cast(length(g) as long) as ingredient_concept_id", "v", "person_id")
    frames = {
        "numeric": ch.numeric_estimates(df, ["g"], ["v"]), "quantiles": ch.quantiles(df, ["v", "person_id"], [0.25, 0.9], ["g"]), "all": ch.quantiles(df, ["v"], [0.5]),
        "nearest": ch.nearest_quantiles(df, "v", [0.5], ["g"]), "durations": pa.event_durations(history), "checks": dc.check_numeric(records, "v"),
    }
    for name, d in frames.items():
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "ObjectHashAggregate" not in plan and "Python" not in plan, name
    numeric = {r.g: r for r in frames["numeric"].collect()}
    exact = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY v)")
    for r in df.groupBy("g").agg(exact(0.25).alias("q25"), F.percentile("v", F.lit(0.5)).alias("median"), exact(0.75).alias("q75"), F.stddev_samp("v").alias("sd"), F.count("*").alias("n"), F.count("v").alias("k")).collect():
        mine = numeric[r.g]
        assert (mine.q25, mine.q75, mine.n_missing) == (r.q25, r.q75, r.n - r.k) and mine.median == (None if r.median is None else pytest.approx(r.median))
    got = {r.g: r for r in frames["quantiles"].collect()}
    assert set(got) == {g for g in groups if g != "wide"} and got["none"].q25_v is None and got["none"].q90_person_id == 1
