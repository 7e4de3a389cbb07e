"""Pregnancy episodes from outcome records, from gestational timing, and merged.

The sequential parts are folds over a person's sorted records inside Spark's own expressions; a person's records are
few. Episodes are numbered by person and date, without a global counter.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eralith.functions.kernels import packed_age

#: Outcome category -> longest term in days.
LONGEST_TERM = {"LB": 308, "SB": 308, "AB": 308, "SA": 168, "DELIV": 308, "ECT": 84}
#: Categories that end late; days between outcomes when both, one or none of two are such.
LATE, SPACING = ("LB", "SB", "DELIV"), {2: 168, 1: 56, 0: 42}
#: Leftover records' window; gaps and tolerance of gestational timing; longest episode.
GESTATION_WINDOW, MOST_GAP, DISAGREE_GAP, TOLERANCE, MOST_DAYS = 305, 300, 30, 2, 365
_EPISODE = "array<struct<start:date,end:date,category:string,outcome:date,n:int>>"


def _episode(start: Column, end: Column, category: Column, outcome: Column, n: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), category.alias("category"), outcome.alias("outcome"), n.cast("int").alias("n"))


def _spread(df: DataFrame) -> DataFrame:
    d = df.select("person_id", F.posexplode("eps").alias("i", "e"))
    return d.select("person_id", (F.col("i") + 1).cast("long").alias("episode_id"), F.col("e.start").alias("episode_start_date"), F.col("e.end").alias("episode_end_date"), F.col("e.category").alias("category"), F.col("e.outcome").alias("outcome_date"), F.col("e.n").cast("long").alias("n_records"))


def outcome_episodes(records: DataFrame, gestation: bool = True) -> DataFrame:
    """Episodes of (person_id, record_date, category): outcomes from the latest back, each far enough before the last one.

    An episode begins the outcome's longest term before it. With gestation, records of no episode that are no outcomes
    form episodes of their own ("PREG"), each up to 305 days after its first record.
    """
    known = F.create_map(*(F.lit(x) for kv in LONGEST_TERM.items() for x in kv))
    late = lambda c: c.isin(*LATE).cast("int")
    spacing = F.create_map(*(F.lit(x) for kv in SPACING.items() for x in kv))
    is_outcome = F.col("category").isin(*LONGEST_TERM)
    outcomes = F.sort_array(F.collect_list(F.when(is_outcome, F.struct("record_date", "category"))), asc=False)
    others = F.array_sort(F.collect_list(F.when(F.coalesce(~is_outcome, F.lit(True)), F.col("record_date"))))
    people = records.groupBy("person_id").agg(outcomes.alias("o"), others.alias("g"))
    kept = F.aggregate(
        "o", F.array().cast("array<struct<record_date:date,category:string>>"),
        lambda acc, x: F.when(
            (F.size(acc) == 0) | (F.datediff(F.element_at(acc, -1)["record_date"], x["record_date"]) >= spacing[late(x["category"]) + late(F.element_at(acc, -1)["category"])]),
            F.concat(acc, F.array(x)),
        ).otherwise(acc),
    )
    people = people.withColumn("o", kept)
    people = people.withColumn("eps", F.transform("o", lambda x: _episode(F.date_sub(x["record_date"], known[x["category"]]), x["record_date"], x["category"], x["record_date"], F.lit(1))))
    if not gestation:
        return _spread(people.withColumn("eps", F.array_sort("eps")))
    # dates inside an episode, or of outcome records, are taken
    free = F.filter("g", lambda g: ~F.exists("eps", lambda e: (g >= e["start"]) & (g <= e["end"])))
    people = people.withColumn("free", free)
    groups = F.aggregate(
        "free", F.array().cast(_EPISODE),
        lambda acc, g: F.when(
            (F.size(acc) == 0) | (F.datediff(g, F.element_at(acc, -1)["start"]) > GESTATION_WINDOW),
            F.concat(acc, F.array(_episode(g, g, F.lit("PREG"), F.lit(None).cast("date"), F.lit(1)))),
        ).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(_episode(F.element_at(acc, -1)["start"], g, F.lit("PREG"), F.lit(None).cast("date"), F.element_at(acc, -1)["n"] + 1)))),
    )
    return _spread(people.withColumn("eps", F.array_sort(F.concat("eps", groups))))


def timing_episodes(records: DataFrame) -> DataFrame:
    """Episodes of (person_id, record_date, min_month, max_month) by agreement with the expected month.

    A record opens an episode if it comes over 300 days after the last one, or over 30 days after it and at a time since
    the episode's start that lies over two months outside its months. Episodes over 365 days are removed.
    """
    r = records.groupBy("person_id").agg(F.array_sort(F.collect_list(F.struct("record_date", "min_month", "max_month"))).alias("r"))

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        gap, months = F.datediff(x["record_date"], last["end"]), F.datediff(x["record_date"], last["start"]) / 30.0
        agrees = x["min_month"].isNull() | x["max_month"].isNull() | months.between(x["min_month"] - TOLERANCE, x["max_month"] + TOLERANCE)
        new = (gap > MOST_GAP) | (~agrees & (gap > DISAGREE_GAP))
        one = _episode(x["record_date"], x["record_date"], F.lit("PREG"), F.lit(None).cast("date"), F.lit(1))
        more = _episode(last["start"], x["record_date"], F.lit("PREG"), F.lit(None).cast("date"), last["n"] + 1)
        return F.when((F.size(acc) == 0) | new, F.concat(acc, F.array(one))).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(more)))

    eps = F.aggregate("r", F.array().cast(_EPISODE), step)
    return _spread(r.withColumn("eps", F.filter(eps, lambda e: F.datediff(e["end"], e["start"]) <= MOST_DAYS)))


def merge_episodes(hip: DataFrame, pps: DataFrame) -> DataFrame:
    """Overlapping episodes of the two kinds paired one to one, nearest ends first; the others stay as they are."""
    h = hip.select("person_id", F.struct(F.col("episode_id").alias("h"), F.col("episode_start_date").alias("s"), F.col("episode_end_date").alias("e"), "category", "outcome_date").alias("hip"))
    p = pps.select("person_id", F.struct(F.col("episode_id").alias("p"), F.col("episode_start_date").alias("s"), F.col("episode_end_date").alias("e"), "n_records").alias("pps"))
    pairs = h.join(p, "person_id").where("hip.s <= pps.e and pps.s <= hip.e")
    pairs = pairs.groupBy("person_id").agg(F.array_sort(F.collect_list(F.struct(F.abs(F.datediff("hip.e", "pps.e")).alias("d"), F.col("hip.h").alias("h"), F.col("pps.p").alias("p")))).alias("c"))
    taken = F.aggregate(
        "c", F.array().cast("array<struct<d:int,h:bigint,p:bigint>>"),
        lambda acc, x: F.when(F.exists(acc, lambda a: (a["h"] == x["h"]) | (a["p"] == x["p"])), acc).otherwise(F.concat(acc, F.array(x))),
    )
    m = pairs.select("person_id", F.explode(taken).alias("m")).select("person_id", "m.h", "m.p")
    a = h.withColumn("h", F.col("hip.h")).join(m, ["person_id", "h"], "left")
    both = a.join(p.withColumn("p", F.col("pps.p")), ["person_id", "p"], "full")
    source = F.when(F.col("hip").isNull(), "PPS").when(F.col("pps").isNull(), "HIP").otherwise("HIP+PPS")
    return both.select(
        "person_id", F.least("hip.s", "pps.s").alias("episode_start_date"), F.greatest("hip.e", "pps.e").alias("episode_end_date"),
        F.coalesce("hip.category", F.lit("PREG")).alias("category"), F.col("hip.outcome_date").alias("outcome_date"), F.coalesce("pps.n_records", F.lit(0)).alias("n_records"), source.alias("source"),
    )


#: Concept of a trimester -> its months.
TRIMESTERS = {3025455: (0, 3), 3025456: (3, 6), 3025457: (6, 9)}


def refine_starts(episodes: DataFrame, evidence: DataFrame, trimesters: dict[int, tuple[int, int]] | None = None) -> DataFrame:
    """Episodes with esd_start_date, gestational_age_weeks, precision and final_start_date.

    evidence (person_id, record_date, kind, concept_id, weeks): kind GW has a number of weeks, kind GR3m a trimester's
    concept; it counts within 30 days of an episode. The latest weeks from 1 to 45 give the start ("high"), otherwise the
    middle of the trimesters that the records share, or of all they span, before the first record ("medium"); with
    neither ("low") the outcome's longest term, or the start as it was.
    """
    months = trimesters or TRIMESTERS
    low, high = (F.create_map(*(F.lit(x) for k, v in months.items() for x in (k, v[i]))) for i in (0, 1))
    e = evidence.select(
        F.col("person_id").alias("_p"), F.col("record_date").alias("_d"), F.col("kind").alias("_k"), F.col("weeks").cast("double").alias("_w"),
        F.try_element_at(low, F.col("concept_id").cast("int")).alias("_lo"), F.try_element_at(high, F.col("concept_id").cast("int")).alias("_hi"),
    )
    on = (F.col("person_id") == F.col("_p")) & F.col("_d").between(F.date_sub("episode_start_date", 30), F.date_add("episode_end_date", 30))
    is_gw, is_gr = (F.col("_k") == "GW") & F.col("_w").isNotNull(), F.col("_k") == "GR3m"
    d = episodes.join(e, on, "left").groupBy(episodes.columns).agg(
        F.max(F.when(is_gw, F.struct("_d", "_w"))).alias("_g"), F.min(F.when(is_gr, F.col("_d"))).alias("_first"),
        F.max(F.when(is_gr, F.col("_lo"))).alias("_a"), F.min(F.when(is_gr, F.col("_hi"))).alias("_b"),
        F.min(F.when(is_gr, F.col("_lo"))).alias("_least"), F.max(F.when(is_gr, F.col("_hi"))).alias("_most"),
    )
    weeks = F.col("_g._w")
    sure = F.coalesce(weeks.between(1, 45), F.lit(False))
    middle = F.when(F.col("_a") <= F.col("_b"), F.col("_a") + F.col("_b")).otherwise(F.col("_least") + F.col("_most")) / 2.0
    start = F.when(sure, F.date_sub(F.col("_g._d"), F.floor(weeks * 7).cast("int"))).otherwise(F.date_sub("_first", F.floor(middle * 30).cast("int")))
    term = F.create_map(*(F.lit(x) for kv in LONGEST_TERM.items() for x in kv))
    by_outcome = F.date_sub("outcome_date", F.try_element_at(term, F.col("category")))
    return d.withColumns({
        "esd_start_date": start, "gestational_age_weeks": F.when(sure, weeks).otherwise(middle * 4.33),
        "precision": F.when(sure, "high").when(middle.isNotNull(), "medium").otherwise("low"),
        "final_start_date": F.coalesce(start, by_outcome, F.col("episode_start_date")),
    }).drop("_g", "_first", "_a", "_b", "_least", "_most")


def collect_records(c, concepts: DataFrame, domains: tuple[str, ...] = ("condition", "procedure", "observation", "measurement")) -> DataFrame:
    """(person_id, record_date, category, concept_id) of all records of several domains whose concept (concept_id, category) tells of a pregnancy."""
    from functools import reduce

    events = reduce(DataFrame.unionByName, [c.events(d) for d in domains])
    return events.join(concepts, "concept_id").select("person_id", F.col("start_date").alias("record_date"), "category", "concept_id")


@dataclass(frozen=True)
class Pregnancies:
    """What identify_pregnancies has found at each stage; all frames are lazy."""

    #: Refined episodes: merged with esd_start_date, gestational_age_weeks, precision and final_start_date.
    episodes: DataFrame
    by_outcome: DataFrame
    by_timing: DataFrame
    merged: DataFrame
    #: Persons with any record that counted, in one row.
    n_persons: DataFrame
    settings: dict[str, Any] = field(default_factory=dict)


def within(c, records: DataFrame, start: str | None = None, end: str | None = None, ages: tuple[int, int] | None = (10, 55)) -> DataFrame:
    """Records (person_id, record_date, ...) within dates, of persons whose completed age then lies within bounds (both included).

    Persons who are not known, or whose year of birth is not, have no age and no records.
    """
    from eralith.operators.enrich import birth_date

    d = records
    d = d.where(F.col("record_date") >= F.lit(start).cast("date")) if start else d
    d = d.where(F.col("record_date") <= F.lit(end).cast("date")) if end else d
    if ages is None:
        return d
    who = c["person"].select(F.col("person_id").alias("_p"), birth_date().alias("_birth"))
    d = d.join(who, F.col("person_id") == F.col("_p")).where(packed_age(F.col("_birth"), F.col("record_date")).between(*ages))
    return d.select(records.columns)


def identify_pregnancies(
    c, outcomes: DataFrame, timing: DataFrame, evidence: DataFrame, start: str | None = None, end: str | None = None,
    ages: tuple[int, int] | None = (10, 55), gestation: bool = True, trimesters: dict[int, tuple[int, int]] | None = None,
) -> Pregnancies:
    """Pregnancy episodes from a container's records in one call: by outcome, by timing, merged, and with refined starts.

    outcomes (person_id, record_date, category), timing (person_id, record_date, min_month, max_month) and evidence (as in
    refine_starts) are bounded by dates and ages first, so that an episode rests on records within them alone.
    """
    o, t, e = (within(c, r, start, end, ages) for r in (outcomes, timing, evidence))
    hip, pps = outcome_episodes(o, gestation), timing_episodes(t)
    merged = merge_episodes(hip, pps)
    people = o.select("person_id").unionByName(t.select("person_id")).unionByName(e.select("person_id"))
    settings = {"start_date": start, "end_date": end, "age_bounds": list(ages) if ages else None, "just_gestation": gestation}
    return Pregnancies(refine_starts(merged, e, trimesters), hip, pps, merged, people.agg(F.count_distinct("person_id").alias("n_persons")), settings)


def validate_episodes(episodes: DataFrame, most_days: int = MOST_DAYS) -> DataFrame:
    """One row: inverted, over-long and overlapping episodes."""
    from pyspark.sql import Window

    w = Window.partitionBy("person_id").orderBy("episode_start_date", "episode_end_date")
    d = episodes.withColumn("_b", F.lag("episode_end_date").over(w))
    n = lambda test: F.coalesce(F.sum(test.cast("long")), F.lit(0))
    s, e = F.col("episode_start_date"), F.col("episode_end_date")
    return d.agg(F.count("*").alias("n_episodes"), n(e < s).alias("n_inverted"), n(F.datediff(e, s) > most_days).alias("n_long"), n(F.coalesce(F.col("_b") >= s, F.lit(False))).alias("n_overlapping"))


def summarise_episodes(episodes: DataFrame) -> DataFrame:
    days = F.datediff("episode_end_date", "episode_start_date")
    return episodes.groupBy("category", "source").agg(F.count("*").alias("n_episodes"), F.count_distinct("person_id").alias("n_persons"), F.avg(days).alias("mean_days"))
