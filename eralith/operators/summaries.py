"""Summarised results of every kind of analysis: its frame, melted to the long result table, and the settings that name it.

Each function returns (result, settings); results.bind puts several below one another.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eralith.operators import characterise as ch
from eralith.operators import cohort as co
from eralith.operators import drug as dr
from eralith.operators import drug_checks as dc
from eralith.operators import enrich as en
from eralith.operators import results as rs
from eralith.operators.cohort_table import CohortTable
from eralith.sources.clinical import Clinical

Result = tuple[DataFrame, DataFrame]
_NUMBERS = {"min": "numeric", "q25": "numeric", "median": "numeric", "q75": "numeric", "max": "numeric", "mean": "numeric", "sd": "numeric"}


def _settings(df: DataFrame, kind: str, **more: object) -> DataFrame:
    """One row: result_id, result_type and the analysis' parameters as text."""
    names = {"result_type": kind, **{k: str(v) for k, v in more.items()}}
    return df.sparkSession.createDataFrame([(1, *names.values())], ", ".join(["result_id long", *(f"{k} string" for k in names)]))


def _named(t: CohortTable, entries: DataFrame) -> DataFrame:
    return entries.join(F.broadcast(t.settings.select("cohort_definition_id", "cohort_name")), "cohort_definition_id")


def summarise_cohort_count(t: CohortTable, strata: Sequence[Sequence[str]] = ()) -> Result:
    """Records and subjects of each cohort, overall and by each set of strata columns of its entries."""
    d = _named(t, t.entries)
    parts = []
    for by in [[], *map(list, strata)]:
        n = d.groupBy("cohort_name", *by).agg(F.count("*").alias("number_records"), F.count_distinct("subject_id").alias("number_subjects"))
        for column, name in (("number_records", "Number records"), ("number_subjects", "Number subjects")):
            parts.append(rs.melt(n.withColumn("count", F.col(column)), ["cohort_name"], by, name, {"count": "integer"}))
    return reduce(DataFrame.unionByName, parts), _settings(d, "summarise_cohort_count")


def summarise_cohort_attrition(t: CohortTable) -> Result:
    d = _named(t, t.attrition).withColumn("reason_id", F.col("reason_id").cast("string"))
    counts = ("number_records", "number_subjects", "excluded_records", "excluded_subjects")
    parts = [rs.melt(d.withColumn("count", F.col(c)).drop(*counts), ["cohort_name"], ["reason", "reason_id"], c, {"count": "integer"}) for c in counts]
    return reduce(DataFrame.unionByName, parts), _settings(d, "summarise_cohort_attrition")


def summarise_cohort_codelist(t: CohortTable) -> Result:
    """Concepts of each cohort's codelists."""
    n = _named(t, t.codelist).groupBy("cohort_name", "codelist_name", "codelist_type").agg(F.count_distinct("concept_id").alias("count"))
    return rs.melt(n, ["cohort_name"], ["codelist_name", "codelist_type"], "Number concepts", {"count": "integer"}), _settings(n, "summarise_cohort_codelist")


def summarise_characteristics(c: Clinical, t: CohortTable, strata: Sequence[Sequence[str]] = (), numeric: Sequence[str] = (), categorical: Sequence[str] = ()) -> Result:
    """Counts, age, observation before and after, days in the cohort and sex, and further columns of the entries.

    One pass over the entries for each set of strata.
    """
    d = en.add_demographics(c, _named(t, t.entries)).withColumn("days_in_cohort", F.datediff("cohort_end_date", "cohort_start_date") + 1)
    numbers, levels = ["age", "prior_observation", "future_observation", "days_in_cohort", *numeric], ["sex", *categorical]
    parts = [summarise_cohort_count(t, strata)[0]]
    for by in [[], *map(list, strata)]:
        n = ch.numeric_estimates(d, ["cohort_name", *by], numbers)
        parts.append(rs.melt(n, ["cohort_name"], by, "variable", _NUMBERS))
        k = ch.categorical_estimates(d, ["cohort_name", *by], [x for x in levels if x not in by] or levels)
        parts.append(rs.melt(k, ["cohort_name"], by, "variable", {"count": "integer", "percentage": "percentage"}, level="level"))
    return reduce(DataFrame.unionByName, parts), _settings(d, "summarise_characteristics")


def _pairs(t: CohortTable, d: DataFrame) -> DataFrame:
    names = t.settings.select("cohort_definition_id", "cohort_name")
    for side, name in (("cohort_a", "cohort_name_reference"), ("cohort_b", "cohort_name_comparator")):
        d = d.join(F.broadcast(names.select(F.col("cohort_definition_id").alias(side), F.col("cohort_name").alias(name))), side)
    return d


def summarise_cohort_overlap(t: CohortTable) -> Result:
    d = _pairs(t, ch.cohort_overlap(t.entries))
    group = ["cohort_name_reference", "cohort_name_comparator"]
    total = F.col("only_a") + F.col("only_b") + F.col("both")
    parts = [
        rs.melt(d.withColumns({"count": F.col(c), "percentage": F.col(c) * 100 / total}), group, [], name, {"count": "integer", "percentage": "percentage"})
        for c, name in (("only_a", "Only in reference cohort"), ("both", "In both cohorts"), ("only_b", "Only in comparator cohort"))
    ]
    return reduce(DataFrame.unionByName, parts), _settings(d, "summarise_cohort_overlap")


def summarise_cohort_timing(t: CohortTable) -> Result:
    d = _pairs(t, ch.cohort_timing(t.entries)).withColumnsRenamed({"n": "count", "min_days": "min", "mean_days": "mean", "max_days": "max"})
    return rs.melt(d, ["cohort_name_reference", "cohort_name_comparator"], [], "Days between cohort entries", {"count": "integer", "min": "integer", "mean": "numeric", "max": "integer"}), _settings(d, "summarise_cohort_timing")


def summarise_large_scale_characteristics(c: Clinical, t: CohortTable, domain: str = "condition", windows: Sequence[tuple[int | None, int | None]] = ((None, -366), (-365, -31), (-30, -1), (0, 0), (1, 30), (31, 365), (366, None)), minimum: float = 0.5) -> Result:
    """Concepts of one domain around entry: concept names as variables, windows as levels; shares below minimum percent are left out."""
    n = ch.large_scale(t.entries, c.events(domain), windows, minimum)
    d = en.add_concept_name(c, _named(t, n), "concept_id").withColumn("variable", F.coalesce("concept_id_name", F.col("concept_id").cast("string")))
    out = rs.melt(d, ["cohort_name"], [], "variable", {"count": "integer", "percentage": "percentage"}, level="window", additional=["concept_id"])
    return out, _settings(d, "summarise_large_scale_characteristics", table_name=domain)


def summarise_drug_utilisation(c: Clinical, t: CohortTable, concepts: DataFrame, gap: int = 30, repeats: bool = False) -> Result:
    """Distribution of every measure of drug use over a cohort's entries; repeats: as in drug.exposures."""
    d = dr.add_drug_use(c, _named(t, t.entries), concepts, gap, repeats=repeats)
    n = ch.numeric_estimates(d, ["cohort_name"], list(dr.METRICS)).withColumn("count_missing", F.col("n_missing"))
    return rs.melt(n, ["cohort_name"], [], "variable", _NUMBERS | {"count_missing": "integer"}), _settings(d, "summarise_drug_utilisation", gap_era=gap)


def _shares(t: CohortTable, d: DataFrame, column: str, kind: str, variable: str, **more: object) -> Result:
    n = ch.categorical_estimates(_named(t, d), ["cohort_name"], [column]).withColumn("variable", F.lit(variable))
    return rs.melt(n, ["cohort_name"], [], "variable", {"count": "integer", "percentage": "percentage"}, level="level"), _settings(n, kind, **more)


def summarise_indication(t: CohortTable, cohorts: DataFrame, names: Mapping[int, str], window: tuple[int | None, int | None]) -> Result:
    return _shares(t, dr.indication(t.entries, cohorts, dict(names), window), "indication", "summarise_indication", "Indication", window=window)


def summarise_treatment(t: CohortTable, cohorts: DataFrame, names: Mapping[int, str], window: tuple[int | None, int | None]) -> Result:
    return _shares(t, dr.add_treatment(t.entries, cohorts, names, window), "treatment", "summarise_treatment", "Treatment", window=window)


def summarise_drug_restart(c: Clinical, t: CohortTable, switch: DataFrame, follow_up: Sequence[int] = (180, 365)) -> Result:
    d = _named(t, dr.restart(t.entries, switch, c, follow_up))
    n = ch.categorical_estimates(d, ["cohort_name"], [f"drug_restart_{x}" for x in follow_up])
    return rs.melt(n, ["cohort_name"], [], "variable", {"count": "integer", "percentage": "percentage"}, level="level"), _settings(d, "summarise_drug_restart")


def summarise_proportion_of_patients_covered(c: Clinical, t: CohortTable, days: int) -> Result:
    d = _named(t, dr.proportion_covered(t.entries, c, days)).withColumnsRenamed({"n_covered": "outcome_count", "n_observed": "denominator_count"}).withColumn("day", F.col("day").cast("string"))
    return rs.melt(d, ["cohort_name"], [], "Overall", {"outcome_count": "integer", "denominator_count": "integer", "ppc": "percentage"}, additional=["day"]), _settings(d, "summarise_proportion_of_patients_covered")


def summarise_drug_diagnostics(c: Clinical, ingredients: Sequence[int], sample: int | None = 10_000, least: int = 5) -> Result:
    """Every drug check as result rows: the ingredient as group, the check as variable, its columns as estimates."""
    parts = []
    for check, d in dc.execute_checks(c, ingredients, None, sample, least).items():
        level = next((x for x in ("variable", "category") if x in d.columns), None)
        kinds = {f.name: "numeric" if f.dataType.typeName() == "double" else "integer" for f in d.schema if f.name not in ("ingredient_concept_id", level)}
        parts.append(rs.melt(d, ["ingredient_concept_id"], [], check, kinds, level=level))
    out = reduce(DataFrame.unionByName, parts)
    return out, _settings(out, "summarise_drug_diagnostics", sample=sample, min_cell_count=least)


def summarise_pregnancies(episodes: DataFrame) -> Result:
    """Episodes, persons and lengths by outcome category and by what the episode rests on."""
    d = episodes.withColumn("days", F.datediff("episode_end_date", "episode_start_date"))
    n = d.groupBy("category", "source").agg(F.count("*").alias("number_records"), F.count_distinct("person_id").alias("number_subjects"))
    parts = [rs.melt(n.withColumn("count", F.col(x)), ["category"], ["source"], name, {"count": "integer"}) for x, name in (("number_records", "Number records"), ("number_subjects", "Number subjects"))]
    parts.append(rs.melt(ch.numeric_estimates(d, ["category", "source"], ["days"]), ["category"], ["source"], "variable", _NUMBERS))
    return reduce(DataFrame.unionByName, parts), _settings(d, "summarise_pregnancies")


def as_incidence_result(estimates: DataFrame, name: str = "incidence") -> Result:
    """Incidence estimates as result rows: the interval as additional pairs."""
    d = estimates.withColumnsRenamed({"n_persons": "denominator_count", "n_events": "outcome_count"}).withColumns({x: F.col(x).cast("string") for x in ("interval_start", "interval_end")})
    kinds = {"denominator_count": "integer", "outcome_count": "integer", "person_days": "integer", "person_years": "numeric", "rate_100000": "numeric"}
    return rs.melt(d, ["cohort_definition_id"], [], "Outcome", kinds, additional=["interval_start", "interval_end"]), _settings(d, name)


def as_prevalence_result(estimates: DataFrame, name: str = "prevalence") -> Result:
    d = estimates.withColumnsRenamed({"n_persons": "denominator_count", "n_cases": "outcome_count"}).withColumns({x: F.col(x).cast("string") for x in ("interval_start", "interval_end")})
    kinds = {"denominator_count": "integer", "outcome_count": "integer", "prevalence": "numeric", "lower": "numeric", "upper": "numeric"}
    return rs.melt(d, ["cohort_definition_id"], [], "Outcome", kinds, additional=["interval_start", "interval_end"]), _settings(d, name)


def as_survival_result(estimates: DataFrame, name: str = "survival_probability") -> Result:
    """Kaplan-Meier steps as result rows: the time as additional pair."""
    d = estimates.withColumn("time", F.col("time").cast("string"))
    kinds = {"n_risk": "integer", "n_events": "integer", "n_censored": "integer", "survival": "numeric", "se": "numeric"}
    return rs.melt(d, ["cohort_definition_id"], [], "Outcome", kinds, additional=["time"]), _settings(d, name)


def available_grouping(result: DataFrame) -> list[str]:
    """Names among a result's group and strata pairs that take more than one level: what a plot or table may group by."""
    pairs = [F.arrays_zip(F.split(f"{k}_name", rs.SEPARATOR).alias("n"), F.split(f"{k}_level", rs.SEPARATOR).alias("v")) for k in ("group", "strata")]
    p = result.select(F.explode(F.concat(*pairs)).alias("p")).select(F.col("p.n").alias("name"), F.col("p.v").alias("level"))
    n = p.where("name != 'overall'").groupBy("name").agg(F.count_distinct("level").alias("n")).where("n > 1")
    return sorted(r["name"] for r in n.select("name").toLocalIterator())


def cohort_table(c: Clinical, concepts: Mapping[str, Sequence[int]], **options: object) -> CohortTable:
    """Concept cohorts with their settings and codelists."""
    spark = c["person"].sparkSession
    settings = spark.createDataFrame([(k, n) for k, n in enumerate(concepts, 1)], "cohort_definition_id long, cohort_name string")
    codes = spark.createDataFrame([(k, n, int(i), "index event") for k, n in enumerate(concepts, 1) for i in concepts[n]], "cohort_definition_id long, codelist_name string, concept_id long, codelist_type string")
    return CohortTable.of(co.concept_cohort(c, concepts, **options), settings, codelist=codes)
