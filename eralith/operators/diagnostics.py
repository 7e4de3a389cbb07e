"""Checks of drug records, hashes and snapshots of a database."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eralith.sources.clinical import Clinical


def drug_missing(drug: DataFrame) -> DataFrame:
    """(variable, n_records, n_missing, share) of every column, in one scan."""
    cols = drug.columns
    one = drug.agg(F.count("*").alias("_n"), *(F.sum(F.col(x).isNull().cast("long")).alias(x) for x in cols))
    rows = F.explode(F.array(*(F.struct(F.lit(x).alias("variable"), F.col("_n").alias("n_records"), F.coalesce(F.col(x), F.lit(0)).alias("n_missing")) for x in cols)))
    return one.select(rows.alias("r")).select("r.*").withColumn("share", F.when(F.col("n_records") > 0, F.col("n_missing") / F.col("n_records")))


def drug_durations(drug: DataFrame) -> DataFrame:
    """Per concept: records, days of exposure (inclusive), and how many end before they start."""
    days = F.datediff("drug_exposure_end_date", "drug_exposure_start_date") + 1
    return drug.groupBy("drug_concept_id").agg(F.count("*").alias("n_records"), F.count_distinct("person_id").alias("n_persons"), F.min(days).alias("min_days"), F.avg(days).alias("mean_days"), F.max(days).alias("max_days"), F.sum((days < 1).cast("long")).alias("n_negative"))


def drug_days_between(drug: DataFrame) -> DataFrame:
    """Per concept: days between the starts of a person's successive records."""
    from pyspark.sql import Window

    w = Window.partitionBy("drug_concept_id", "person_id").orderBy("drug_exposure_start_date", "drug_exposure_end_date")
    gap = F.datediff("drug_exposure_start_date", F.lag("drug_exposure_start_date").over(w))
    return drug.withColumn("_g", gap).groupBy("drug_concept_id").agg(F.count("_g").alias("n_gaps"), F.min("_g").alias("min_gap"), F.avg("_g").alias("mean_gap"), F.max("_g").alias("max_gap"))


def data_hash(c: Clinical, keys: dict[str, str]) -> DataFrame:
    """(table, n_rows, n_distinct, hash) of each table by one of its columns."""
    one = lambda t, k: c[t].agg(F.lit(t).alias("table"), F.count("*").alias("n_rows"), F.count_distinct(k).alias("n_distinct"))
    d = reduce(DataFrame.unionByName, [one(t, k) for t, k in keys.items()])
    return d.withColumn("hash", F.md5(F.concat_ws("|", "table", "n_rows", "n_distinct")))


def benchmark(c: Clinical) -> dict[str, float]:
    """Seconds of six probes: distinct and grouped counts, a join, a collected table and ranges by sex."""
    import time

    drug, person = c["drug_exposure"], c["person"]
    probes = {
        "distinct_concepts": drug.select("drug_concept_id").distinct(), "records_by_concept": drug.groupBy("drug_concept_id").count(),
        "join_person": drug.join(person, "person_id"), "persons": person, "join_concept": drug.join(c["concept"], drug["drug_concept_id"] == c["concept"]["concept_id"]),
        "birth_years_by_sex": person.groupBy("gender_concept_id").agg(F.min("year_of_birth"), F.max("year_of_birth")),
    }
    out = {}
    for name, df in probes.items():
        begin = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        out[name] = time.perf_counter() - begin
    return out


def snapshot_with_source(c: Clinical) -> DataFrame:
    """The snapshot with the vocabulary's version and the source's own words, where the tables are there; else null."""
    text = lambda table, where, column: c[table].where(where).agg(F.max(column).alias(column)) if table in c else None
    d = snapshot(c).withColumn("cdm_name", F.lit(c.name))
    for part, name in ((text("vocabulary", "vocabulary_id = 'None'", "vocabulary_version"), "vocabulary_version"), (text("cdm_source", "true", "cdm_source_name"), "cdm_source_name")):
        d = d.crossJoin(part) if part is not None else d.withColumn(name, F.lit(None).cast("string"))  # one row each
    return d


def snapshot(c: Clinical) -> DataFrame:
    """One row: persons, observation periods, first and last observed day."""
    op = c["observation_period"].agg(F.count("*").alias("observation_periods"), F.min("observation_period_start_date").alias("earliest"), F.max("observation_period_end_date").alias("latest"))
    return c["person"].agg(F.count_distinct("person_id").alias("persons")).crossJoin(op)  # one row each
