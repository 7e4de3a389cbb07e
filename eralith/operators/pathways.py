"""Treatment pathways: eras, combinations and sequences of treatments after a target entry."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eralith.functions.kernels import islands
from eralith.functions.quantiles import beside, interpolated

#: Steps of one person: from when, until when, which treatments.
_ROWS = "array<struct<s:date,e:date,t:array<string>>>"


def _row(s: Column, e: Column, t: Column) -> Column:
    return F.struct(s.alias("s"), e.alias("e"), t.alias("t"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def combined(eras: Column, combination_window: int, overlap: str = "truncate") -> Column:
    """The steps that a person's eras (sorted rows of start, end, [treatment]) come to: a fold over the eras by start.

    The fold's state is what is done and what is active: the rows that may still overlap something, sorted. Before an era
    is taken up, the active rows that lie before it are settled: the first one is done if the second starts no earlier
    than it ends; otherwise the two become the parts before, during and after their overlap. As eras of one treatment
    don't overlap, no more rows are active at a time than there are treatments and parts of their overlaps.
    """
    if overlap not in ("truncate", "keep"):
        raise ValueError("overlap must be truncate or keep")

    def parts(a: Column, b: Column, both: Column, switch: Column) -> Column:
        before = _row(a.s, b.s, a.t)
        switched = F.array(before, _row(b.s, F.when(both == b.t, F.greatest(a.e, b.e)).otherwise(b.e), b.t))
        first_stops = F.array(before, _row(b.s, a.e, both), _row(a.e, b.e, b.t))
        last_stops = F.array(before, _row(b.s, b.e, both), _row(b.e, a.e, a.t))
        return F.filter(F.when(switch, switched).when(a.e <= b.e, first_stops).otherwise(last_stops), lambda r: r.e > r.s)

    def settle(state: Column, until: Column | None) -> Column:
        active = state.active
        ready = F.size(active) >= 2 if until is None else F.coalesce(F.get(active, 1) < until, F.lit(False))
        pair = F.struct(F.get(active, 0).alias("a"), F.get(active, 1).alias("b"), F.array_sort(F.array_union(F.get(active, 0).t, F.get(active, 1).t)).alias("both"))

        def met(p: Column) -> Column:
            a, b, both = p.a, p.b, p.both
            switch = (F.datediff(F.least(a.e, b.e), b.s) < combination_window) | (both == a.t) | (both == b.t)
            done = (b.s >= a.e) | switch if overlap == "keep" else b.s >= a.e
            passed = F.struct(F.concat(state.done, F.array(a)).alias("done"), F.slice(active, 2, F.size(active)).alias("active"))
            parted = F.struct(state.done.alias("done"), F.array_sort(F.concat(parts(a, b, both, switch), F.slice(active, 3, F.size(active)))).alias("active"))
            return F.when(done, passed).otherwise(parted)

        return F.when(ready, _let(pair, met)).otherwise(state)

    def settled(state: Column, until: Column | None) -> Column:
        # each step lessens what n rows cover between their 2 n bounds, or passes a row on
        n = F.size(state.active)
        return F.when(n < 2, state).otherwise(F.aggregate(F.sequence(F.lit(1), 2 * n * n + n), state, lambda st, _: settle(st, until)))

    def take(state: Column, era: Column) -> Column:
        return _let(settled(state, era), lambda before: F.struct(before.done.alias("done"), F.array_sort(F.concat(before.active, F.array(era))).alias("active")))

    def finish(state: Column) -> Column:
        return _let(settled(state, None), lambda last: F.concat(last.done, last.active))

    none = F.array().cast(_ROWS)
    return F.aggregate(eras, F.struct(none.alias("done"), none.alias("active")), take, finish)


def treatment_history(
    target: DataFrame, events: DataFrame, names: Mapping[int, str], era_gap: int = 30, least_era: int = 0,
    combination_window: int = 30, filter_treatments: str = "first", overlap: str = "truncate",
) -> DataFrame:
    """(person_id, sequence, treatments array, start_date, end_date) of events that start within the target entry.

    Eras of one treatment are merged over era_gap days. Where two overlap for combination_window days or more they form
    a combination; a shorter overlap is a switch, which ends the earlier one (overlap "truncate") or leaves both as they
    are ("keep"). filter_treatments: "all", "first" (each treatment's first time) or "changes" (no repeat of the one
    before). A person's eras are folded in one expression; there are no more of them than days and treatments allow.
    """
    label = F.create_map(*(F.lit(x) for k, v in names.items() for x in (k, v)))
    e = events.select(F.col("subject_id").alias("person_id"), label[F.col("cohort_definition_id").cast("int")].alias("treatment"), F.col("cohort_start_date").alias("start_date"), F.col("cohort_end_date").alias("end_date"))
    t = target.select(F.col("subject_id").alias("person_id"), F.col("cohort_start_date").alias("_s"), F.col("cohort_end_date").alias("_e"))
    e = e.join(t, "person_id").where("start_date between _s and _e").select("person_id", "treatment", "start_date", F.least("end_date", "_e").alias("end_date"))
    e = islands(e, ["person_id", "treatment"], "start_date", "end_date", era_gap).where(F.datediff("end_date", "start_date") >= least_era)
    eras = e.groupBy("person_id").agg(F.array_sort(F.collect_list(_row(F.col("start_date"), F.col("end_date"), F.array("treatment")))).alias("eras"))
    steps = eras.select("person_id", combined(F.col("eras"), combination_window, overlap).alias("steps"))
    of = lambda i: F.get(F.col("steps.t"), i)
    stays = {"all": None, "first": lambda r, i: F.array_position(F.col("steps.t"), r.t) == i + 1, "changes": lambda r, i: (i == 0) | (of(i - 1) != r.t)}[filter_treatments]
    steps = steps.select("person_id", F.filter("steps", stays).alias("steps")) if stays else steps
    return steps.select("person_id", F.posexplode("steps").alias("i", "r")).select("person_id", (F.col("i") + 1).cast("long").alias("sequence"), F.col("r.t").alias("treatments"), F.col("r.s").alias("start_date"), F.col("r.e").alias("end_date"))


def pathway_counts(history: DataFrame, least: int = 0) -> DataFrame:
    """(pathway, n_persons): treatments joined by + within a step and by - between steps."""
    steps = history.groupBy("person_id").agg(F.array_sort(F.collect_list(F.struct("sequence", F.array_join("treatments", "+").alias("t")))).alias("s"))
    return steps.groupBy(F.array_join("s.t", "-").alias("pathway")).agg(F.count("*").alias("n_persons")).where(F.col("n_persons") >= least)


def first_eras(events: DataFrame, names: Mapping[int, str], era_gap: int = 30) -> DataFrame:
    """(pathway, n_persons) of the order in which persons first began each treatment; no combinations, all in SQL."""
    label = F.create_map(*(F.lit(x) for k, v in names.items() for x in (k, v)))
    e = events.groupBy("subject_id", "cohort_definition_id").agg(F.min("cohort_start_date").alias("s"))
    e = e.select("subject_id", "s", label[F.col("cohort_definition_id").cast("int")].alias("t"))
    return e.groupBy("subject_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("s", "t")))["t"], "-").alias("pathway")).groupBy("pathway").agg(F.count("*").alias("n_persons"))


def event_durations(history: DataFrame) -> DataFrame:
    """(treatment, kind, n_events, n_persons, min, median, mean and max days) of each treatment or combination."""
    kind = F.when(F.size("treatments") > 1, "combination").otherwise("single")
    d = history.select("person_id", F.array_join("treatments", "+").alias("treatment"), kind.alias("kind"), F.datediff("end_date", "start_date").alias("days"))
    by = ["treatment", "kind"]
    plain = d.groupBy(*by).agg(F.count("*").alias("n_events"), F.count_distinct("person_id").alias("n_persons"), F.min("days").alias("min_days"), F.avg("days").alias("mean_days"), F.max("days").alias("max_days"))
    both = beside(plain, interpolated(d, by, "days", {"median_days": 0.5}), by)
    return both.select(*by, "n_events", "n_persons", "min_days", "median_days", "mean_days", "max_days")


def split_by_duration(events: DataFrame, number: int, cutoff: int, long_number: int) -> DataFrame:
    """Events of one cohort that last cutoff days or more, renumbered as a cohort of their own."""
    is_long = (F.col("cohort_definition_id") == number) & (F.datediff("cohort_end_date", "cohort_start_date") >= cutoff)
    return events.withColumn("cohort_definition_id", F.when(is_long, F.lit(long_number).cast("long")).otherwise(F.col("cohort_definition_id")))


def anchored(target: DataFrame, start: str = "start", start_days: int = 0, end: str = "end", end_days: int = 0) -> DataFrame:
    """Target entries moved to a window around their start or end, in which treatments are looked for."""
    at = {"start": F.col("cohort_start_date"), "end": F.col("cohort_end_date")}
    d = target.withColumns({"_a": F.date_add(at[start], start_days), "_b": F.date_add(at[end], end_days)}).where("_a <= _b")
    return d.withColumns({"cohort_start_date": F.col("_a"), "cohort_end_date": F.col("_b")}).drop("_a", "_b")


def shortened(history: DataFrame, most: int) -> DataFrame:
    """The first steps of each pathway."""
    return history.where(F.col("sequence") <= most)
