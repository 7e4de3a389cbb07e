"""Cohort generation from concept sets, and requirements, subsets and counts of cohorts.

A cohort is a DataFrame (cohort_definition_id, subject_id, cohort_start_date, cohort_end_date).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eralith.functions.kernels import closure, islands, pick
from eralith.sources.clinical import DOMAINS, Clinical

#: Codes that a resolved concept set may have to be broadcast (about 2 MB).
MOST_CODES = 50_000
COHORT = ["cohort_definition_id", "subject_id", "cohort_start_date", "cohort_end_date"]


def _resolved(c: Clinical, concepts: Mapping[str, Sequence[int]], descendants: bool, excluded: Sequence[int]) -> DataFrame:
    """(cohort_definition_id, concept_id, domain) of the named sets, numbered in order: seeds and their descendants less the excluded ones'."""
    rows = [(k, int(i), descendants, False) for k, ids in enumerate(concepts.values(), 1) for i in ids] + [(k, int(i), True, True) for k in range(1, len(concepts) + 1) for i in excluded]
    names = ["name", "concept_id", "include_descendants", "is_excluded"]
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    # as Arrow, so that the planner has the seeds themselves and sends them to the scan as a filter would be
    seeds = c["concept"].sparkSession.createDataFrame(pa.table({n: pa.array(list(x), t) for n, x, t in zip(names, columns, types, strict=True)}))
    codes = closure(seeds, c["concept_ancestor"], excluding=bool(excluded))
    domain = c["concept"].select("concept_id", F.lower("domain_id").alias("domain"))
    return codes.join(domain, "concept_id").select(F.col("name").alias("cohort_definition_id"), "concept_id", "domain")


def concept_events(c: Clinical, concepts: Mapping[str, Sequence[int]], descendants: bool = True, excluded: Sequence[int] = ()) -> DataFrame:
    """(cohort_definition_id, person_id, start_date, end_date) of all events with a concept of each named set.

    Only domains that the concepts belong to are read.
    """
    resolved = _resolved(c, concepts, descendants, excluded)
    # a codelist of bounded size is resolved once and known to the planner, size included; a longer one stays a join
    head = resolved.limit(MOST_CODES + 1).toArrow()
    if head.num_rows <= MOST_CODES:
        domains = set(head["domain"].to_pylist()) & set(DOMAINS)
        resolved = c["concept"].sparkSession.createDataFrame(head)
    else:
        domains = {r.domain for r in resolved.select("domain").distinct().collect() if r.domain in DOMAINS}
    out = None
    for d in sorted(domains):
        e = c.events(d).join(resolved.where(F.col("domain") == d).drop("domain"), "concept_id")
        e = e.select("cohort_definition_id", "person_id", "start_date", "end_date")
        out = e if out is None else out.unionByName(e)
    return out if out is not None else c["concept"].sparkSession.createDataFrame([], "cohort_definition_id long, person_id long, start_date date, end_date date")


def concept_cohort(
    c: Clinical, concepts: Mapping[str, Sequence[int]], limit: str = "first", prior: int = 0, future: int = 0,
    end: str | int = "observation", gap: int = 0, excluded: Sequence[int] = (),
) -> DataFrame:
    """Events that start inside observation with enough days before and after, one or all, collapsed.

    end: "observation", "event" or a number of days from the start; never past the end of observation.
    """
    op = c["observation_period"].select("person_id", F.col("observation_period_start_date").alias("o_start"), F.col("observation_period_end_date").alias("o_end"))
    e = concept_events(c, concepts, excluded=excluded).join(op, "person_id")
    e = e.where((F.col("start_date") >= F.date_add("o_start", prior)) & (F.col("start_date") <= F.date_sub("o_end", future)))
    stop = F.col("o_end") if end == "observation" else F.col("end_date") if end == "event" else F.date_add("start_date", end)
    e = e.select("cohort_definition_id", F.col("person_id").alias("subject_id"), F.col("start_date").alias("cohort_start_date"), F.least(stop, "o_end").alias("cohort_end_date"))
    if limit == "first":
        # one entry a subject has nothing to be merged with
        return e.groupBy(*COHORT[:2]).agg(F.min(F.struct(*COHORT[2:])).alias("s")).select(*COHORT[:2], "s.*")
    return islands(e, COHORT[:2], *COHORT[2:], gap=gap)


def event_cohort(events: DataFrame, person: str, start: str, end: str, number: int = 1) -> DataFrame:
    """A cohort of each event as it is."""
    return events.select(F.lit(number).cast("long").alias(COHORT[0]), F.col(person).alias(COHORT[1]), F.col(start).alias(COHORT[2]), F.col(end).alias(COHORT[3]))


def cohort_counts(cohort: DataFrame) -> DataFrame:
    return cohort.groupBy(COHORT[0]).agg(F.count("*").alias("number_records"), F.count_distinct("subject_id").alias("number_subjects"))


def require_first(cohort: DataFrame) -> DataFrame:
    return pick(cohort, COHORT[:2], COHORT[2:])


def require_prior_washout(cohort: DataFrame, days: int) -> DataFrame:
    """Entries that start more than days after the end of the subject's entry before, or have none."""
    from pyspark.sql import Window

    w = Window.partitionBy(*COHORT[:2]).orderBy(*COHORT[2:])
    before = F.lag("cohort_end_date").over(w)
    return cohort.withColumn("_b", before).where(F.col("_b").isNull() | (F.datediff("cohort_start_date", "_b") > days)).drop("_b")


def require_in_range(cohort: DataFrame, lo: str | None, hi: str | None) -> DataFrame:
    """Entries that start within dates."""
    if lo:
        cohort = cohort.where(F.col("cohort_start_date") >= F.lit(lo).cast("date"))
    return cohort.where(F.col("cohort_start_date") <= F.lit(hi).cast("date")) if hi else cohort


def require_demographics(c: Clinical, cohort: DataFrame, ages: tuple[int, int] = (0, 150), sex: int | None = None, prior: int = 0, future: int = 0) -> DataFrame:
    from eralith.operators.enrich import add_demographics

    d = add_demographics(c, cohort)
    d = d.where(F.col("age").between(*ages) & (F.col("prior_observation") >= prior) & (F.col("future_observation") >= future))
    return (d.where(F.col("gender_concept_id") == sex) if sex else d).select(cohort.columns)


def subset_to_cohort(c: Clinical, cohort: DataFrame) -> Clinical:
    """Every table that has persons, for the cohort's subjects alone."""
    ids = cohort.select(F.col("subject_id").alias("person_id")).distinct()
    return c.changed(lambda t: t.join(ids, "person_id", "left_semi") if "person_id" in t.columns else t)


def sample_persons(c: Clinical, n: int, seed: int = 0) -> Clinical:
    """n persons by the order of a seeded hash: the same ones every time."""
    ids = c["person"].join(c["observation_period"], "person_id", "left_semi").select("person_id").distinct()
    ids = ids.orderBy(F.md5(F.concat_ws("|", F.lit(seed), "person_id")), "person_id").limit(n)
    return c.changed(lambda t: t.join(ids, "person_id", "left_semi") if "person_id" in t.columns else t)


def flatten(c: Clinical, domains: Sequence[str] = ("condition", "drug", "procedure", "measurement", "visit", "death", "observation")) -> DataFrame:
    """Distinct (person_id, concept_id, start_date, end_date, domain) of several domains under one roof."""
    out = None
    for d in domains:
        e = c.events(d).distinct().withColumn("domain", F.lit(d))
        out = e if out is None else out.unionByName(e)
    return out


def intersect_cohorts(cohort: DataFrame, ids: Sequence[int], number: int) -> DataFrame:
    """Time that a subject spends in all the cohorts at once: days where as many are open as there are cohorts."""
    from pyspark.sql import Window

    merged = islands(cohort.where(F.col("cohort_definition_id").isin(list(ids))), COHORT[:2], *COHORT[2:], gap=1)
    step = F.explode(F.array(F.struct(F.col("cohort_start_date").alias("d"), F.lit(1).alias("x")), F.struct(F.date_add("cohort_end_date", 1).alias("d"), F.lit(-1).alias("x"))))
    e = merged.select("subject_id", step.alias("e")).groupBy("subject_id", F.col("e.d").alias("d")).agg(F.sum("e.x").alias("x"))
    w = Window.partitionBy("subject_id").orderBy("d")
    e = e.withColumns({"open": F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)), "to": F.date_sub(F.lead("d").over(w), 1)}).where(F.col("open") == len(set(ids)))
    out = e.select(F.lit(number).cast("long").alias(COHORT[0]), "subject_id", F.col("d").alias(COHORT[2]), F.col("to").alias(COHORT[3]))
    return islands(out, COHORT[:2], *COHORT[2:], gap=1)


def union_cohorts(cohort: DataFrame, ids: Sequence[int], number: int, gap: int = 0) -> DataFrame:
    d = cohort.where(F.col("cohort_definition_id").isin(list(ids))).withColumn("cohort_definition_id", F.lit(number).cast("long"))
    return islands(d, COHORT[:2], *COHORT[2:], gap=gap)


def pad_dates(c: Clinical, cohort: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """Entries lengthened by days at either end, kept inside their observation period, and merged anew."""
    op = c["observation_period"].select(F.col("person_id").alias("_p"), F.col("observation_period_start_date").alias("_s"), F.col("observation_period_end_date").alias("_e"))
    d = cohort.join(op, (F.col("subject_id") == F.col("_p")) & F.col("cohort_start_date").between(F.col("_s"), F.col("_e")))
    d = d.withColumns({"cohort_start_date": F.greatest(F.date_sub("cohort_start_date", before), "_s"), "cohort_end_date": F.least(F.date_add("cohort_end_date", after), "_e")})
    return islands(d.where("cohort_start_date <= cohort_end_date"), COHORT[:2], *COHORT[2:])


def attrition(steps: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """(reason_id, reason, number_records, number_subjects, excluded_records, excluded_subjects) of named steps."""
    from functools import reduce

    from pyspark.sql import Window

    one = lambda k, n, d: d.agg(F.lit(k).cast("long").alias("reason_id"), F.lit(n).alias("reason"), F.count("*").alias("number_records"), F.count_distinct("subject_id").alias("number_subjects"))
    a = reduce(DataFrame.unionByName, [one(k, n, d) for k, (n, d) in enumerate(steps, 1)])
    w = Window.orderBy("reason_id")  # over one row per step
    lost = lambda x: F.coalesce(F.lag(x).over(w) - F.col(x), F.lit(0))
    return a.withColumns({"excluded_records": lost("number_records"), "excluded_subjects": lost("number_subjects")})
