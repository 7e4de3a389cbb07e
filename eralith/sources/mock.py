"""Seeded clinical tables for trials: every value is a hash of the seed and the row's number, so it needs no driver data."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from eralith.sources.clinical import Clinical


def _uniform(seed: int, what: str, n: int, *keys: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), *keys), F.lit(n)).cast("int")


def mock_clinical(spark: SparkSession, persons: int = 100, seed: int = 42, concepts: int = 20, events: int = 8) -> Clinical:
    """person, observation_period, drug_exposure, condition_occurrence, death, concept and concept_ancestor."""
    p = spark.range(1, persons + 1).withColumnRenamed("id", "person_id")
    start = F.date_add(F.lit("2000-01-01").cast("date"), _uniform(seed, "start", 3000, "person_id"))
    person = p.select("person_id", F.when(_uniform(seed, "sex", 2, "person_id") == 0, 8507).otherwise(8532).cast("long").alias("gender_concept_id"), (1930 + _uniform(seed, "year", 60, "person_id")).alias("year_of_birth"), (1 + _uniform(seed, "month", 12, "person_id")).alias("month_of_birth"), (1 + _uniform(seed, "day", 28, "person_id")).alias("day_of_birth"))
    op = p.select("person_id", start.alias("observation_period_start_date"), F.date_add(start, 365 + _uniform(seed, "length", 5000, "person_id")).alias("observation_period_end_date"))
    e = op.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(events))))
    span = F.datediff("observation_period_end_date", "observation_period_start_date")
    at = lambda w: F.date_add("observation_period_start_date", F.pmod(F.xxhash64(F.lit(seed), F.lit(w), "person_id", "n"), span).cast("int"))
    concept = lambda w: (1 + _uniform(seed, w + "c", concepts, "person_id", "n")).cast("long")
    days = 1 + _uniform(seed, "days", 60, "person_id", "n")
    drug = e.select("person_id", concept("drug").alias("drug_concept_id"), at("drug").alias("drug_exposure_start_date"), F.date_add(at("drug"), days - 1).alias("drug_exposure_end_date"), days.cast("double").alias("quantity"), days.cast("long").alias("days_supply"))
    condition = e.select((F.col("person_id") * 1000 + F.col("n")).alias("condition_occurrence_id"), "person_id", (concept("cond") + 1000).alias("condition_concept_id"), at("cond").alias("condition_start_date"), at("cond").alias("condition_end_date"))
    death = op.where(_uniform(seed, "death", 10, "person_id") == 0).select("person_id", F.col("observation_period_end_date").alias("death_date"))
    c = spark.range(1, concepts + 1)
    both = c.select(F.col("id").alias("concept_id"), F.concat(F.lit("drug "), "id").alias("concept_name"), F.lit("Drug").alias("domain_id"), F.lit("Ingredient").alias("concept_class_id"), F.lit("S").alias("standard_concept")).unionByName(
        c.select((F.col("id") + 1000).alias("concept_id"), F.concat(F.lit("condition "), "id").alias("concept_name"), F.lit("Condition").alias("domain_id"), F.lit("Disorder").alias("concept_class_id"), F.lit("S").alias("standard_concept"))
    )
    tree = both.select(F.col("concept_id").alias("ancestor_concept_id"), F.col("concept_id").alias("descendant_concept_id"), F.lit(0).alias("min_levels_of_separation"))
    return Clinical({"person": person, "observation_period": op, "drug_exposure": drug, "condition_occurrence": condition, "death": death, "concept": both, "concept_ancestor": tree}, name="mock")
