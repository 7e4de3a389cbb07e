"""Denominators, incidence and prevalence."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eralith.functions.kernels import calendar, islands, overlap_days, packed_age, wilson
from eralith.functions.sweeps import point, points, segments
from eralith.operators.enrich import birth_date
from eralith.sources.clinical import Clinical


def denominator(c: Clinical, start: str | None = None, end: str | None = None, ages: Sequence[tuple[int, int]] = ((0, 150),), sexes: Sequence[str] = ("Both",), prior: int = 0) -> DataFrame:
    """Person-time at risk: one cohort for each age group and sex, numbered in the order given, in one pass over persons.

    Start: the latest of observation start (plus prior days), study start and the birthday that enters the age group;
    end: the earliest of observation end, study end and the day before the birthday that leaves it.
    """
    p = c["person"].select("person_id", birth_date().alias("birth"), F.when(F.col("gender_concept_id") == 8507, "Male").otherwise("Female").alias("sex"))
    op = c["observation_period"].join(p, "person_id")
    specs = [(i, a, s) for i, (a, s) in enumerate(((a, s) for a in ages for s in sexes), 1)]
    spec = F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("id"), F.lit(a[0]).alias("lo"), F.lit(a[1]).alias("hi"), F.lit(s).alias("want")) for i, a, s in specs)))
    d = op.withColumn("_spec", spec).select("*", "_spec.*").where("want = 'Both' or want = sex")
    bound = lambda v, other: F.lit(v).cast("date") if v else other
    o_start, o_end = F.col("observation_period_start_date"), F.col("observation_period_end_date")
    s = F.greatest(F.date_add(o_start, prior), bound(start, o_start), F.when(F.col("lo") > 0, F.add_months("birth", F.col("lo") * 12)).otherwise(o_start))
    e = F.least(o_end, bound(end, o_end), F.date_sub(F.add_months("birth", (F.col("hi") + 1) * 12), 1))
    d = d.select(F.col("id").alias("cohort_definition_id"), F.col("person_id").alias("subject_id"), s.alias("cohort_start_date"), e.alias("cohort_end_date"))
    return d.where("cohort_start_date <= cohort_end_date")


def target_denominator(
    c: Clinical, target: DataFrame, time_at_risk: Sequence[tuple[int, int | None]] = ((0, None),), ages: Sequence[tuple[int, int]] = ((0, 150),),
    sexes: Sequence[str] = ("Both",), prior: int = 0,
) -> DataFrame:
    """Time at risk within target entries: days lo to hi after the start, for those who meet age, sex and prior days then."""
    p = c["person"].select(F.col("person_id").alias("subject_id"), birth_date().alias("birth"), F.when(F.col("gender_concept_id") == 8507, "Male").otherwise("Female").alias("sex"))
    op = c["observation_period"].select(F.col("person_id").alias("_p"), F.col("observation_period_start_date").alias("o_start"), F.col("observation_period_end_date").alias("o_end"))
    specs = [(i, a, s, t) for i, (a, s, t) in enumerate(((a, s, t) for a in ages for s in sexes for t in time_at_risk), 1)]
    spec = F.array(*(F.struct(F.lit(i).cast("long").alias("id"), F.lit(a[0]).alias("lo"), F.lit(a[1]).alias("hi"), F.lit(s).alias("want"), F.lit(t[0]).alias("t0"), F.lit(t[1]).cast("int").alias("t1")) for i, a, s, t in specs))
    index = F.col("cohort_start_date")
    d = target.select("subject_id", "cohort_start_date", "cohort_end_date").join(p, "subject_id")
    d = d.join(op, (F.col("subject_id") == F.col("_p")) & index.between(F.col("o_start"), F.col("o_end"))).withColumn("_spec", F.explode(spec)).select("*", "_spec.*")
    d = d.where((F.col("want").isin("Both") | (F.col("want") == F.col("sex"))) & packed_age(F.col("birth"), index).between(F.col("lo"), F.col("hi")) & (F.datediff(index, "o_start") >= prior))
    end = F.least("cohort_end_date", "o_end", F.when(F.col("t1").isNotNull(), F.date_add(index, F.col("t1"))))
    d = d.select(F.col("id").alias("cohort_definition_id"), "subject_id", F.date_add(index, F.col("t0")).alias("_s"), end.alias("_e"))
    return d.where("_s <= _e").select("cohort_definition_id", "subject_id", F.col("_s").alias("cohort_start_date"), F.col("_e").alias("cohort_end_date"))


def censored(denominator: DataFrame, censor: DataFrame) -> DataFrame:
    """Time at risk cut the day before each person's first censoring event."""
    first = censor.groupBy("subject_id").agg(F.date_sub(F.min("cohort_start_date"), 1).alias("_c"))
    d = denominator.join(first, "subject_id", "left").withColumn("cohort_end_date", F.least("cohort_end_date", "_c")).drop("_c")
    return d.where("cohort_start_date <= cohort_end_date").select(denominator.columns)


def complete_intervals(estimates: DataFrame, denominator: DataFrame) -> DataFrame:
    """Estimates of the intervals that lie inside the span of all time at risk; the span is one row."""
    span = denominator.agg(F.min("cohort_start_date").alias("_lo"), F.max("cohort_end_date").alias("_hi"))
    return estimates.join(F.broadcast(span), (F.col("interval_start") >= F.col("_lo")) & (F.col("interval_end") <= F.col("_hi"))).drop("_lo", "_hi")


def by_strata(denominator: DataFrame, strata: DataFrame, columns: Sequence[str], estimate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """estimate() within each level of the strata columns of (subject_id, columns...), which come back as columns.

    The levels travel inside the cohort id, so one pass estimates all strata.
    """
    d = denominator.join(strata.select("subject_id", *columns), "subject_id").withColumn("cohort_definition_id", F.struct("cohort_definition_id", *columns))
    out = estimate(d).withColumnRenamed("cohort_definition_id", "_id")
    return out.select("_id.*", *(c for c in out.columns if c != "_id"))


def _cut(time: DataFrame, interval: str, whole: DataFrame) -> DataFrame:
    """Rows of time with each calendar interval (interval_start, interval_end) that they touch; "overall": their cohort's span in whole."""
    if interval == "overall":
        span = whole.groupBy("cohort_definition_id").agg(F.min("cohort_start_date").alias("interval_start"), F.max("cohort_end_date").alias("interval_end"))
        return time.join(span, "cohort_definition_id")
    i = F.explode(calendar(F.col("cohort_start_date"), F.col("cohort_end_date"), interval))
    return time.withColumn("_i", i).withColumns({"interval_start": F.col("_i.start"), "interval_end": F.col("_i.end")}).drop("_i")


def time_at_risk(denominator: DataFrame, outcome: DataFrame, washout: int | None = None, repeated: bool = False) -> DataFrame:
    """(cohort_definition_id, subject_id, cohort_start_date, cohort_end_date, n_events): what is left of time at risk, in stretches.

    From the day after an outcome starts until washout days after it has ended nobody is at risk; without washout never again,
    outcomes before the denominator included. A day on which an outcome starts while at risk is a stretch of its own with one
    event; an outcome that starts within another's washout counts for nothing. Without repeated, a person's time in a
    cohort also ends with the first event counted. Rows of one subject and cohort that overlap are taken together.

    Denominator, outcomes and washout are points of one sweep: running sums tell which days are observed, which are cut
    and which have an event; no interval is held against another.
    """
    keys = ["cohort_definition_id", "subject_id"]
    start, end, behind = F.col("cohort_start_date"), F.col("cohort_end_date"), lambda c: F.date_add(c, 1)
    none = {"seen": 0, "cut": 0, "event": 0}
    seen = points(denominator, keys, point(start, **none | {"seen": 1}), point(behind(end), **none | {"seen": -1}))
    o = outcome.select("subject_id", "cohort_start_date", F.greatest("cohort_start_date", "cohort_end_date").alias("cohort_end_date")).where(start.isNotNull()).distinct()
    o = denominator.select(*keys).distinct().join(o, "subject_id")
    back = [] if washout is None else [point(F.date_add(end, washout + 1), **none | {"cut": -1})]
    cuts = points(o, keys, point(start, **none | {"event": 1}), point(behind(start), **none | {"event": -1, "cut": 1}), *back)
    d = segments(seen.unionByName(cuts), keys, list(none)).where("seen > 0 and cut = 0").withColumn("n_events", (F.col("event") > 0).cast("int"))
    if not repeated:
        earlier = F.sum("n_events").over(Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
        d = d.withColumn("_earlier", F.coalesce(earlier, F.lit(0))).where("_earlier = 0")
    return d.select(*keys, F.col("start").alias("cohort_start_date"), F.col("end").alias("cohort_end_date"), "n_events")


def strict_incidence(denominator: DataFrame, outcome: DataFrame, interval: str = "years", washout: int | None = None, repeated: bool = False) -> DataFrame:
    """incidence() over time_at_risk(): time stops at the event, outcomes and washout take time away, events outside a person's own time don't count."""
    d = _cut(time_at_risk(denominator, outcome, washout, repeated), interval, denominator)
    d = d.withColumn("_days", overlap_days(*map(F.col, ("cohort_start_date", "cohort_end_date", "interval_start", "interval_end"))))
    per = d.groupBy("cohort_definition_id", "subject_id", "interval_start", "interval_end").agg(F.sum("_days").alias("_days"), F.sum("n_events").alias("_n"))
    return _rates(per)


def _rates(per: DataFrame) -> DataFrame:
    """Rates of intervals from (cohort_definition_id, subject_id, interval_start, interval_end, _days, _n)."""
    out = per.groupBy("cohort_definition_id", "interval_start", "interval_end").agg(F.count("*").alias("n_persons"), F.sum("_days").alias("person_days"), F.sum("_n").alias("n_events"))
    years = F.col("person_days") / 365.25
    return out.withColumn("person_years", years).withColumn("rate_100000", F.col("n_events") / years * 100_000)


def incidence(denominator: DataFrame, outcome: DataFrame, interval: str = "years", washout: int | None = None, repeated: bool = False, study: tuple[str, str] | None = None) -> DataFrame:
    """Per calendar interval: persons, days and years at risk, events and the rate per 100,000 person-years.

    Each denominator row is cut at calendar borders, so persons meet intervals by an explode and not by a range join.
    An event counts for those at risk in its interval. Of several events of a person the first counts; with repeated,
    those more than washout days after the last counted one.
    """
    o = outcome.select(F.col("subject_id").alias("_p"), F.col("cohort_start_date").alias("_o")).distinct()
    if not repeated:
        o = o.groupBy("_p").agg(F.min("_o").alias("_o"))
    elif washout:
        # greedy from the last event kept: a fold over the sorted dates
        kept = F.aggregate(
            F.array_sort(F.collect_list("_o")), F.array().cast("array<date>"),
            lambda acc, d: F.when((F.size(acc) == 0) | (F.datediff(d, F.element_at(acc, -1)) > washout), F.concat(acc, F.array(d))).otherwise(acc),
        )
        o = o.groupBy("_p").agg(kept.alias("_k")).select("_p", F.explode("_k").alias("_o"))
    d = _cut(denominator, interval, denominator)
    d = d.withColumn("_days", overlap_days(*map(F.col, ("cohort_start_date", "cohort_end_date", "interval_start", "interval_end"))))
    per = d.groupBy("cohort_definition_id", "subject_id", "interval_start", "interval_end").agg(F.sum("_days").alias("_days"))
    per = per.join(o, (F.col("subject_id") == F.col("_p")) & F.col("_o").between(F.col("interval_start"), F.col("interval_end")), "left")
    per = per.groupBy("cohort_definition_id", "subject_id", "interval_start", "interval_end").agg(F.first("_days").alias("_days"), F.count("_o").alias("_n"))
    return _rates(per)


#: Normal quantile of the limits, and the steps that bring a first guess of a mean to the last digits.
_Z, _STEPS = 1.959963984540054, 12
#: Beyond so many events the guess is right to a billionth already.
_MANY = 1_000_000
#: The first terms of Stirling's series for the logarithm of the gamma function.
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680)


def log_gamma(a: Column) -> Column:
    """Natural logarithm of the gamma function for a > 0: Stirling's series at a + 10, brought down by ten factors."""
    b = a + 10
    series = sum((F.lit(c) / F.pow(b, 2 * i + 1) for i, c in enumerate(_STIRLING)), F.lit(0.0))
    return (b - 0.5) * F.log(b) - b + 0.5 * math.log(2 * math.pi) + series - sum((F.log(a + i) for i in range(10)), F.lit(0.0))


def _mean_where(count: Column, share: float, z: float) -> Column:
    """The mean of a Poisson variable that is count or less with this probability; z is the normal quantile of 1 - share.

    The lower incomplete gamma function of count + 1 at the mean is 1 - share. Newton's steps from the cube-root guess; the
    function is its power series, whose terms are summed until they no longer count.
    """
    a = count + 1.0
    nu = 2 * a
    guess = a * F.pow(1 - 2 / (9 * nu) + z * F.sqrt(2 / (9 * nu)), 3)
    gamma = log_gamma(a)
    many = F.sequence(F.lit(1), F.ceil(20 * F.sqrt(a) + 60).cast("int"))

    def step(x: Column) -> Column:
        density = F.exp((a - 1) * F.log(x) - x - gamma)
        terms = F.aggregate(
            many, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
            lambda s, i: F.struct((s.term * x / (a + i)).alias("term"), (s.sum + s.term * x / (a + i)).alias("sum")), lambda s: s.sum,
        )
        return F.greatest(x - (density * x / a * terms - (1 - share)) / density, x / 2)

    newton = F.aggregate(F.sequence(F.lit(1), F.lit(_STEPS)), F.greatest(guess, F.lit(1e-6)).cast("double"), lambda x, _: step(x))
    return F.when(a > _MANY, guess).otherwise(newton)


def poisson_limits(events: Column | str, person_years: Column | str) -> Column:
    """struct<lower, upper>: exact 95 % limits of a rate per 100,000, as an expression over result rows."""
    events, person_years = (F.col(c) if isinstance(c, str) else c for c in (events, person_years))
    k = events.cast("double")
    lower = F.when(k > 0, _mean_where(F.greatest(k - 1, F.lit(0.0)), 0.975, -_Z)).otherwise(F.lit(0.0))
    return F.struct((lower * 100_000 / person_years).alias("lower"), (_mean_where(k, 0.025, _Z) * 100_000 / person_years).alias("upper"))


def prevalence(denominator: DataFrame, outcome: DataFrame, interval: str = "years", kind: str = "point", full_contribution: bool = False) -> DataFrame:
    """Share of persons with the outcome, at each interval's first day (point) or any time in it (period), Wilson limits."""
    o = islands(outcome.select(F.col("subject_id").alias("_p"), F.col("cohort_start_date").alias("_s"), F.col("cohort_end_date").alias("_e")), ["_p"], "_s", "_e")
    d = _cut(denominator, interval, denominator)
    if kind == "point":
        d = d.withColumn("interval_end", F.col("interval_start"))
    d = d.where("cohort_start_date <= interval_end and cohort_end_date >= interval_start")
    if full_contribution:
        d = d.where("cohort_start_date <= interval_start and cohort_end_date >= interval_end")
    lo, hi = F.greatest("cohort_start_date", "interval_start"), F.least("cohort_end_date", "interval_end")
    hit = d.join(o, (F.col("subject_id") == F.col("_p")) & (F.col("_s") <= hi) & (F.col("_e") >= lo), "left")
    # each subject once, then a plain count: no row is expanded for distinct counts
    one = hit.groupBy("cohort_definition_id", "interval_start", "interval_end", "subject_id").agg(F.max(F.col("_p").isNotNull().cast("int")).alias("_case"))
    out = one.groupBy("cohort_definition_id", "interval_start", "interval_end").agg(F.count("*").alias("n_persons"), F.sum("_case").alias("n_cases"))
    low, high = wilson(F.col("n_cases"), F.col("n_persons"))
    return out.withColumns({"prevalence": F.col("n_cases") / F.col("n_persons"), "lower": low, "upper": high})
