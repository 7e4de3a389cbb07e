"""Time to event: person-level times, Kaplan-Meier, competing risks, risk tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add, and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eralith.sources.clinical import Clinical


def add_survival(c: Clinical, target: DataFrame, outcome: DataFrame, washout: int | None = None, follow_up: int | None = None, name: str = "") -> DataFrame:
    """{name}time and {name}status of each target row: first outcome on or after the index, or end of observation.

    Both are null where an outcome lies in the washout days before the index (None: at any earlier time).
    """
    op = c["observation_period"].select(F.col("person_id").alias("_p"), F.col("observation_period_start_date").alias("_s"), F.col("observation_period_end_date").alias("_e"))
    t = target.join(op, (F.col("subject_id") == F.col("_p")) & F.col("cohort_start_date").between(F.col("_s"), F.col("_e")), "left").drop("_p", "_s")
    o = outcome.select(F.col("subject_id").alias("_p"), F.col("cohort_start_date").alias("_o"))
    index = F.col("cohort_start_date")
    early = F.col("_o") < index if washout is None else (F.col("_o") < index) & (F.datediff(index, "_o") <= washout)
    ids = target.select("subject_id", "cohort_start_date").distinct().join(o, F.col("subject_id") == F.col("_p"))
    found = ids.groupBy("subject_id", "cohort_start_date").agg(F.min(F.when(F.col("_o") >= index, F.col("_o"))).alias("_o"), F.max(early.cast("int")).alias("_early"))
    t = t.join(found, ["subject_id", "cohort_start_date"], "left")
    last = F.datediff("_e", index)
    last = F.least(last, F.lit(follow_up)) if follow_up is not None else last
    days = F.datediff("_o", index)
    event = F.coalesce(days <= last, F.lit(False))
    clean = F.coalesce(F.col("_early"), F.lit(0)) == 0
    return t.withColumns({f"{name}time": F.when(clean, F.when(event, days).otherwise(last)), f"{name}status": F.when(clean, event.cast("int"))}).drop("_e", "_o", "_early")


def _steps(times: DataFrame, by: Sequence[str], *events: str) -> DataFrame:
    """Counts at each distinct time and the number still at risk: windows run over distinct times, not over persons."""
    at = times.where("time is not null").groupBy(*by, "time").agg(F.count("*").alias("n_left"), *(F.sum(F.coalesce(F.col(e), F.lit(0))).cast("long").alias(e) for e in events))
    w = Window.partitionBy(*by).orderBy(F.col("time").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return at.withColumn("n_risk", F.sum("n_left").over(w))


def kaplan_meier(times: DataFrame, by: Sequence[str] = ("cohort_definition_id",)) -> DataFrame:
    """n_risk, n_events, n_censored, survival and its Greenwood standard error at each time of (by..., time, status)."""
    at = _steps(times, by, "status")
    w = Window.partitionBy(*by).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    d, n = F.col("status"), F.col("n_risk")
    at = at.withColumn("_all", F.max((d == n).cast("int")).over(w))
    survival = F.when(F.col("_all") == 1, F.lit(0.0)).otherwise(F.exp(F.sum(F.when(d < n, F.log(1 - d / n)).otherwise(F.lit(0.0))).over(w)))
    green = F.sqrt(F.sum(F.when(d < n, d / (n * (n - d))).otherwise(F.lit(0.0))).over(w))
    out = at.withColumns({"survival": survival, "se": survival * green})
    return out.select(*by, F.col("time").cast("long").alias("time"), "n_risk", d.alias("n_events"), (F.col("n_left") - d).alias("n_censored"), "survival", "se")


def cumulative_incidence(times: DataFrame, by: Sequence[str] = ("cohort_definition_id",)) -> DataFrame:
    """Aalen-Johansen step function of status 1 against competing status 2, of (by..., time, status)."""
    t = times.withColumns({"_one": (F.col("status") == 1).cast("int"), "_two": (F.col("status") == 2).cast("int")})
    at = _steps(t, by, "_one", "_two")
    w = Window.partitionBy(*by).orderBy("time")
    both = F.col("_one") + F.col("_two")
    log = F.when(both < F.col("n_risk"), F.log(1 - both / F.col("n_risk"))).otherwise(F.lit(-1e9))
    before = F.exp(F.coalesce(F.sum(log).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    at = at.withColumn("_d", before * F.col("_one") / F.col("n_risk"))
    out = at.withColumn("cumulative_incidence", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.select(*by, F.col("time").cast("long").alias("time"), "n_risk", F.col("_one").alias("n_events"), F.col("_two").alias("n_competing"), "cumulative_incidence")


def first_cause(times: DataFrame, causes: Mapping[str, str]) -> DataFrame:
    """times with time and cause: the first of several events; cause -> prefix of its add_survival columns.

    Of events on one day the cause named first counts; cause is null where follow-up ends without any. Both are null where
    any of the events lies in its washout.
    """
    at = {c: (F.col(f"{p}time"), F.col(f"{p}status")) for c, p in causes.items()}
    events = [F.when(status == 1, F.struct(time.cast("int").alias("t"), F.lit(i).alias("i"), F.lit(c).alias("c"))) for i, (c, (time, status)) in enumerate(at.items())]
    known = reduce(and_, (time.isNotNull() for time, _ in at.values()))
    first = F.least(*events) if len(events) > 1 else events[0]
    last = F.least(*(time for time, _ in at.values())) if len(at) > 1 else next(iter(at.values()))[0]
    return times.withColumns({"_first": F.when(known, first), "_last": F.when(known, last)}).withColumns({"time": F.coalesce("_first.t", "_last"), "cause": F.col("_first.c")}).drop("_first", "_last")


def cause_incidence(times: DataFrame, causes: Sequence[str], by: Sequence[str] = ("cohort_definition_id",)) -> DataFrame:
    """(by..., time, cause, n_risk, n_events, cumulative_incidence, variance, survival) of (by..., time, cause), a row for each time and cause.

    Aalen-Johansen step functions of all causes in one pass: they and the survival add up to 1 at every time. The variance is
    the delta-method one; its sums over earlier times of squares of what has come since are opened into running sums, so no
    time meets another.
    """
    t = times.where("time is not null").select(*by, "time", *(F.coalesce(F.col("cause") == c, F.lit(False)).cast("int").alias(f"d{k}") for k, c in enumerate(causes)))
    at = _steps(t, by, *(f"d{k}" for k in range(len(causes))))
    w = Window.partitionBy(*by).orderBy("time")
    until, earlier = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    n, d = F.col("n_risk"), reduce(add, (F.col(f"d{k}") for k in range(len(causes))))
    at = at.withColumn("_d", d)
    lost = F.max((F.col("_d") == n).cast("int")).over(earlier)
    before = F.when(F.coalesce(lost, F.lit(0)) == 1, F.lit(0.0)).otherwise(F.exp(F.coalesce(F.sum(F.when(F.col("_d") < n, F.log(1 - F.col("_d") / n))).over(earlier), F.lit(0.0))))
    at = at.withColumns({"_s": before, "_a": F.when(F.col("_d") < n, F.col("_d") / (n * (n - F.col("_d")))).otherwise(F.lit(0.0))})
    at = at.withColumns({f"f{k}": F.sum(F.col("_s") * F.col(f"d{k}") / n).over(until) for k in range(len(causes))})
    for k in range(len(causes)):
        f, e = F.col(f"f{k}"), F.col("_s") * F.col(f"d{k}") / (n * n)
        parts = {"b": f * F.col("_a"), "c": f * f * F.col("_a"), "p": F.col("_s") * e * (n - F.col(f"d{k}")) / n, "e": e, "g": f * e}
        at = at.withColumns({f"_{x}{k}": F.sum(v).over(until) for x, v in parts.items()})
    at = at.withColumn("_all", F.sum("_a").over(until))
    x = lambda name, k: F.col(f"_{name}{k}")
    variance = lambda k: F.col(f"f{k}") * F.col(f"f{k}") * F.col("_all") - 2 * F.col(f"f{k}") * x("b", k) + x("c", k) + x("p", k) - 2 * (F.col(f"f{k}") * x("e", k) - x("g", k))
    each = F.inline(F.array(*(F.struct(F.lit(c).alias("cause"), F.col(f"d{k}").alias("n_events"), F.col(f"f{k}").alias("cumulative_incidence"), F.greatest(variance(k), F.lit(0.0)).alias("variance")) for k, c in enumerate(causes))))
    out = at.withColumn("survival", F.col("_s") * (1 - F.col("_d") / n)).select(*by, F.col("time").cast("long").alias("time"), "n_risk", "survival", each)
    return out.select(*by, "time", "cause", "n_risk", "n_events", "cumulative_incidence", "variance", "survival")


def with_competing(times: DataFrame, outcome: str, competing: str) -> DataFrame:
    """time and status (0, 1 outcome, 2 competing first) from two pairs of add_survival columns."""
    o_t, o_s, c_t, c_s = (F.col(f"{p}{x}") for p in (outcome, competing) for x in ("time", "status"))
    status = F.when((o_s == 1) & ((c_s != 1) | (o_t <= c_t)), 1).when(c_s == 1, 2).otherwise(0)
    known = o_t.isNotNull() & c_t.isNotNull()  # neither event lies in the washout
    return times.withColumns({"status": F.when(known, status), "time": F.when(known, F.least(o_t, c_t))})


def risk_table(times: DataFrame, gap: int, by: Sequence[str] = ("cohort_definition_id",)) -> DataFrame:
    """At risk at the start of each [t, t + gap), and events and censored in it."""
    t = times.where("time is not null").withColumn("interval", F.floor(F.col("time") / gap) * gap)
    at = t.groupBy(*by, "interval").agg(F.count("*").alias("_n"), F.sum("status").cast("long").alias("n_events"))
    w = Window.partitionBy(*by).orderBy(F.col("interval").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return at.withColumn("n_risk", F.sum("_n").over(w)).select(*by, F.col("interval").cast("long").alias("interval"), "n_risk", "n_events", (F.col("_n") - F.col("n_events")).alias("n_censored"))


def survival_summary(km: DataFrame, by: Sequence[str] = ("cohort_definition_id",)) -> DataFrame:
    """Records, events, median survival (first time at 0.5 or below) and restricted mean by the exact step integral."""
    w = Window.partitionBy(*by).orderBy("time")
    d = km.withColumn("_area", F.coalesce(F.lag("survival").over(w), F.lit(1.0)) * (F.col("time") - F.coalesce(F.lag("time").over(w), F.lit(0))))
    return d.groupBy(*by).agg(F.max("n_risk").alias("n_records"), F.sum("n_events").alias("n_events"), F.min(F.when(F.col("survival") <= 0.5, F.col("time"))).alias("median_survival"), F.sum("_area").alias("restricted_mean"))
