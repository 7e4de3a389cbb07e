"""Kernels on edge rows, against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from eralith.functions import kernels as k
from eralith.operators import incidence as ic
from eralith.operators import pathways as pa
from eralith.operators import results as re_
from eralith.operators import survival as su

D = dt.date


def merged(rows, gap):
    out = []
    for s, e in sorted(rows):
        if out and s <= out[-1][1] + dt.timedelta(gap):
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def test_islands(spark):
    rng, day = random.Random(1), lambda n: D(2020, 1, 1) + dt.timedelta(n)
    rows = [(p, day(s), day(s + rng.randrange(20))) for p in range(30) for s in (rng.randrange(200) for _ in range(12))]
    rows += [(99, D(2020, 1, 1), D(2020, 1, 5)), (99, D(2020, 1, 5), D(2020, 1, 6)), (99, D(2020, 1, 7), D(2020, 1, 8)), (99, D(2020, 1, 1), D(2020, 1, 2))]
    df = spark.createDataFrame(rows, "p long, s date, e date")
    for gap in (0, 1, 7):
        got = {}
        for r in k.islands(df, ["p"], "s", "e", gap).collect():
            got.setdefault(r.p, []).append((r.s, r.e))
        for p in got:
            assert sorted(got[p]) == merged([(s, e) for q, s, e in rows if q == p], gap)


def test_age_and_calendar(spark):
    df = spark.createDataFrame([(D(2000, 2, 29), D(2001, 2, 28)), (D(2000, 2, 29), D(2001, 3, 1)), (D(1990, 5, 5), D(2020, 5, 5))], "b date, t date")
    assert [r[0] for r in df.select(k.packed_age(F.col("b"), F.col("t"))).collect()] == [0, 1, 30]
    one = spark.createDataFrame([(D(2019, 11, 15), D(2020, 2, 3))], "a date, b date")
    got = {u: [(r["start"], r["end"]) for r in one.select(k.calendar(F.col("a"), F.col("b"), u).alias("x")).first().x] for u in ("months", "quarters", "years", "overall")}
    assert len(got["months"]) == 4 and got["months"][-1] == (D(2020, 2, 1), D(2020, 2, 29))
    assert got["quarters"] == [(D(2019, 10, 1), D(2019, 12, 31)), (D(2020, 1, 1), D(2020, 3, 31))]
    assert got["years"][1] == (D(2020, 1, 1), D(2020, 12, 31)) and got["overall"] == [(D(2019, 11, 15), D(2020, 2, 3))]


def test_closure_excludes(spark):
    seeds = spark.createDataFrame([("a", 1, True, False), ("a", 3, False, True)], "name string, concept_id long, include_descendants boolean, is_excluded boolean")
    tree = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (3, 3)], "ancestor_concept_id long, descendant_concept_id long")
    assert {r.concept_id for r in k.closure(seeds, tree).collect()} == {1, 2}


def test_washout_is_greedy(spark):
    den = spark.createDataFrame([(1, 1, D(2020, 1, 1), D(2020, 12, 31))], "cohort_definition_id long, subject_id long, cohort_start_date date, cohort_end_date date")
    out = spark.createDataFrame([(1, 1, D(2020, 1, 1) + dt.timedelta(n), D(2020, 1, 1) + dt.timedelta(n)) for n in (0, 20, 40, 41, 90)], den.schema)
    r = ic.incidence(den, out, washout=30, repeated=True).first()
    assert r.n_events == 3 and r.person_days == 366


def test_poisson_limits(spark):
    df = spark.createDataFrame([(0.0, 1.0), (5.0, 100000.0)], "n double, py double").select(ic.poisson_limits("n", "py").alias("x")).select("x.*").collect()
    assert df[0].lower == 0 and abs(df[0].upper / 1e5 - 3.688879) < 1e-4
    assert abs(df[1].lower - 1.623486) < 1e-4 and abs(df[1].upper - 11.668332) < 1e-4


def test_survival(spark):
    rows = [(1, t, s) for t, s in ((1, 1), (2, 0), (2, 1), (4, 2), (5, 1), (None, None))]
    df = spark.createDataFrame(rows, "cohort_definition_id long, time long, status int")
    km = {r.time: r.survival for r in su.kaplan_meier(df.where("status < 2")).collect()}
    assert abs(km[1] - 0.75) < 1e-9 and abs(km[2] - 0.5) < 1e-9 and km[5] == 0
    cif = {r.time: r.cumulative_incidence for r in su.cumulative_incidence(df).collect()}
    assert abs(cif[1] - 0.2) < 1e-9 and abs(cif[2] - 0.4) < 1e-9 and abs(cif[4] - 0.4) < 1e-9 and abs(cif[5] - 0.7) < 1e-9


def test_combinations(spark):
    day = lambda n: D(2020, 1, 1) + dt.timedelta(n)
    schema = "cohort_definition_id long, subject_id long, cohort_start_date date, cohort_end_date date"
    target = spark.createDataFrame([(1, 1, day(0), day(300)), (1, 2, day(0), day(300))], schema)
    events = spark.createDataFrame([(1, 1, day(0), day(60)), (2, 1, day(20), day(100)), (1, 2, day(0), day(60)), (2, 2, day(55), day(90))], schema)
    got = {r.pathway: r.n_persons for r in pa.pathway_counts(pa.treatment_history(target, events, {1: "a", 2: "b"})).collect()}
    assert got == {"a-a+b-b": 1, "a-b": 1}


def test_results(spark):
    df = spark.createDataFrame([("x", "m", 3), ("y", "f", 30)], "g string, s string, n int")
    r = re_.melt(df, ["g"], ["s"], "Number subjects", {"n": "integer"})
    assert tuple(r.columns) == re_.COLUMNS
    out = {x.g: x.estimate_value for x in re_.tidy(re_.suppress(r), ["g"], ["s"]).collect()}
    assert out == {"x": "-", "y": "30"}
    two = re_.split(re_.unite(df.select("g", "s"), ["g", "s"], "group"), "group", ["s", "other"]).collect()
    assert {(x.s, x.other) for x in two} == {("m", "overall"), ("f", "overall")}


def test_stream_equals_batch(spark, tmp_path):
    from eralith.streaming import eras

    t = dt.datetime(2024, 1, 1)
    rows = [(i, t + dt.timedelta(minutes=m), u, "x", 1.0, None) for i, (u, m) in enumerate([(1, 0), (1, 10), (1, 50), (2, 5), (9, 600)])]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    q = eras.sessions(eras.read_events(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("s").outputMode("append").start()
    q.processAllAvailable()
    q.processAllAvailable()
    q.stop()
    batch = {tuple(r) for r in eras.sessions(spark.read.parquet(f"{tmp_path}/in")).where("user_id < 9").collect()}
    assert {tuple(r) for r in spark.table("s").collect()} == batch


def test_intersection_and_attrition(spark):
    from eralith.operators import cohort as co

    schema = "cohort_definition_id long, subject_id long, cohort_start_date date, cohort_end_date date"
    d = spark.createDataFrame([(1, 7, D(2020, 1, 1), D(2020, 1, 20)), (1, 7, D(2020, 2, 1), D(2020, 2, 9)), (2, 7, D(2020, 1, 10), D(2020, 2, 3)), (2, 8, D(2020, 1, 1), D(2020, 1, 2))], schema)
    got = sorted((r.cohort_start_date, r.cohort_end_date) for r in co.intersect_cohorts(d, [1, 2], 9).collect())
    assert got == [(D(2020, 1, 10), D(2020, 1, 20)), (D(2020, 2, 1), D(2020, 2, 3))]
    a = co.attrition([("all", d), ("one", d.where("cohort_definition_id = 1"))]).orderBy("reason_id").collect()
    assert [(r.number_records, r.excluded_records, r.excluded_subjects) for r in a] == [(4, 0, 0), (2, 2, 1)]


def test_result_files_and_mock(spark, tmp_path):
    from eralith.operators import cohort as co
    from eralith.sources.mock import mock_clinical

    c = mock_clinical(spark, 50)
    counts = co.cohort_counts(co.concept_cohort(c, {"a": [1], "b": [1001]}))
    assert {r.cohort_definition_id for r in counts.collect()} == {1, 2}
    r = re_.melt(counts, ["cohort_definition_id"], [], "Number subjects", {"number_subjects": "integer"})
    both = re_.bind(r, r)
    assert {x.result_id for x in both.collect()} == {1, 1001}
    re_.export(both, f"{tmp_path}/r")
    back = re_.read_export(spark, f"{tmp_path}/r")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, both.collect()), key=str)
    one = re_.filter_pairs(back, "group", cohort_definition_id="1")
    assert one.count() == 2 and re_.markdown(one).count("\n") == 3


def test_dose_patterns(spark):
    from eralith.operators import dose as do

    mg, hour, ml = (do.UNITS[u] for u in ("milligram", "hour", "milliliter"))
    rows = [(1, 5.0, mg, None, None, None, None), (2, None, None, 10.0, mg, 48.0, hour), (3, None, None, 2.0, mg, None, hour), (4, None, None, 3.0, mg, 1.0, ml), (5, 5.0, mg, 1.0, mg, None, None), (6, None, None, None, None, None, None)]
    s = spark.createDataFrame(rows, "drug_concept_id long, amount_value double, amount_unit_concept_id int, numerator_value double, numerator_unit_concept_id int, denominator_value double, denominator_unit_concept_id int")
    got = {r.drug_concept_id: r.pattern_id for r in do.strength_patterns(s).collect()}
    assert got == {1: 9, 2: 2, 3: 5, 4: 18, 5: None, 6: None}


def test_definition_raises_on_what_it_lacks(spark):
    """A key that would be ignored raises by its name, where it is set; false and null are as if it were absent."""
    from eralith.operators.definition_types import parse

    def definition(**more):
        return {
            "ConceptSets": [{"id": 0, "expression": {"items": [{"concept": {"CONCEPT_ID": 1}, "isExcluded": False}]}}],
            "PrimaryCriteria": {"CriteriaList": [{"DrugExposure": {"CodesetId": 0, **more}}], "ObservationWindow": {"PriorDays": 3}},
        }

    with pytest.raises(ValueError, match="GeneticMarker"):
        parse(definition(GeneticMarker=1))
    with pytest.raises(ValueError, match="not a known criterion"):
        parse({"PrimaryCriteria": {"CriteriaList": [{"PayerPlanPeriod": {}}]}})
    tree = parse(definition(GeneticMarker=False, DrugType=[{"CONCEPT_ID": 5}], Age={"Value": 3}))
    spec = tree.primary_criteria.criteria_list[0]
    assert spec.domain == "drug" and spec.record_type[0].concept_id == 5 and spec.age.op == "gte" and tree.primary_criteria.observation_window.prior_days == 3
    assert parse({"primaryCriteria": {"criteriaList": [{"drugExposure": {"codesetId": 0}}]}}).primary_criteria.criteria_list[0].codeset_id == 0


def _tables(spark):
    from eralith.sources.clinical import Clinical

    table = lambda schema, *rows: spark.createDataFrame(list(rows), schema).selectExpr(*(f"cast({x.split()[0]} as {x.split()[1]}) as {x.split()[0]}" for x in schema.split(", ")))
    rows = lambda text, *rs: spark.createDataFrame([tuple(map(str, r)) for r in rs], ", ".join(f"{x.split()[0]} string" for x in text.split(", "))).selectExpr(*(f"cast({x.split()[0]} as {x.split()[1]}) as {x.split()[0]}" for x in text.split(", ")))
    return Clinical({
        "person": rows("person_id long, gender_concept_id long, year_of_birth int, race_concept_id long", (1, 8507, 1950, 7), (2, 8532, 1960, 8), (3, 8532, 1970, 7)),
        "observation_period": rows("person_id long, observation_period_start_date date, observation_period_end_date date", *((p, "2000-01-01", "2001-12-31") for p in (1, 2, 3))),
        "concept_ancestor": table("ancestor_concept_id long, descendant_concept_id long", (1, 1), (1, 2)),
        "concept_relationship": rows("concept_id_1 long, concept_id_2 long, relationship_id string", (50, 2, "Maps to"), (51, 9, "Maps to")),
        "drug_exposure": rows(
            "person_id long, drug_concept_id long, drug_exposure_start_date date, drug_exposure_end_date date, visit_occurrence_id long, stop_reason string",
            (1, 2, "2000-03-01", "2000-03-10", 11, "done"), (2, 50, "2000-03-01", "2000-03-10", 21, "stopped early"), (3, 51, "2000-03-01", "2000-03-10", 31, "done"), (3, 1, "2000-05-01", "2000-05-02", 32, "x"),
        ),
        "condition_occurrence": rows(
            "person_id long, condition_concept_id long, condition_start_date date, condition_end_date date, visit_occurrence_id long",
            (1, 5, "2000-03-11", "2000-03-20", 11), (2, 5, "2000-03-05", "2000-04-01", 99), (3, 5, "2000-04-20", "2000-05-01", 32),
        ),
    })


def test_definition_filters(spark):
    """Mapped codes, adjusted dates, text and race filters, nested criteria, windows from either end, visits."""
    from eralith.operators.definition import generate

    c = _tables(spark)

    def persons(criterion=None, member=None, demographic=None, mapped=True):
        rules = {"Type": "ALL", "CriteriaList": [member] if member else [], "DemographicCriteriaList": [demographic] if demographic else []}
        d = {
            "ConceptSets": [{"id": 0, "expression": {"items": [{"concept": {"CONCEPT_ID": 1}, "includeDescendants": True, "includeMapped": mapped}]}}],
            "PrimaryCriteria": {"CriteriaList": [{"DrugExposure": {"CodesetId": 0, **(criterion or {})}}]},
            "InclusionRules": [{"name": "r", "expression": rules}], "EndStrategy": {"DateOffset": {"DateField": "EndDate", "Offset": 0}},
        }
        return sorted((r.subject_id, str(r.cohort_start_date)) for r in generate(c, d)[0].collect())

    assert persons(mapped=False) == [(1, "2000-03-01"), (3, "2000-05-01")]
    assert persons() == [(1, "2000-03-01"), (2, "2000-03-01"), (3, "2000-05-01")]
    assert persons({"StopReason": {"Text": "early", "Op": "contains"}}) == [(2, "2000-03-01")]
    assert persons({"DateAdjustment": {"StartWith": "END_DATE", "StartOffset": -1, "EndWith": "END_DATE", "EndOffset": 3}}) == [(1, "2000-03-09"), (2, "2000-03-09"), (3, "2000-05-01")]
    assert persons(demographic={"Race": [{"CONCEPT_ID": 7}]}) == [(1, "2000-03-01"), (3, "2000-05-01")]
    ill = {"Criteria": {"ConditionOccurrence": {}}}
    assert persons(member=ill | {"RestrictVisit": True}) == [(1, "2000-03-01"), (3, "2000-05-01")]
    after_end = {"Start": {"Days": 1, "Coeff": 1}, "End": {"Days": 5, "Coeff": 1}, "UseIndexEnd": True}
    assert persons(member=ill | {"StartWindow": after_end}) == [(1, "2000-03-01")]
    until_start = {"Start": {"Days": 5, "Coeff": -1}, "End": {"Days": 0, "Coeff": 1}, "UseEventEnd": True}
    assert persons(member=ill | {"StartWindow": until_start}) == [(3, "2000-05-01")]
    nested = {"CorrelatedCriteria": {"Type": "ALL", "CriteriaList": [{"Criteria": {"ConditionOccurrence": {}}, "StartWindow": {"Start": {"Days": 0, "Coeff": 1}, "End": {"Days": 5, "Coeff": 1}}}]}}
    assert persons(nested) == [(2, "2000-03-01")]


def test_definition_plan_grows_by_rule(spark):
    """Relations in the optimised plan: as many more for every further rule, however many there are."""
    from eralith.operators.definition import generate

    c = _tables(spark)
    rule = {"name": "r", "expression": {"Type": "ALL", "CriteriaList": [{"Criteria": {"ConditionOccurrence": {}}, "StartWindow": {"Start": {"Days": 9, "Coeff": -1}, "End": {"Days": 9, "Coeff": 1}}}]}}

    def relations(n):
        made = generate(c, {"ConceptSets": [], "PrimaryCriteria": {"CriteriaList": [{"DrugExposure": {}}]}, "InclusionRules": [rule] * n})
        return [df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + df._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") for df in made]

    one, five, nine = relations(1), relations(5), relations(9)
    assert [b - a for a, b in zip(one, five, strict=True)] == [b - a for a, b in zip(five, nine, strict=True)] and max(nine) < 40
