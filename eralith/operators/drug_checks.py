"""Drug record checks by ingredient: one pass joins records to their ingredients, each check is a grouped aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eralith.functions.quantiles import beside, interpolated
from eralith.sources.clinical import Clinical

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
#: check -> what it needs: a categorical column, or an expression whose distribution is told.
CATEGORICAL = {"route": "route"}
NUMERIC = {
    "exposure_duration": "datediff(drug_exposure_end_date, drug_exposure_start_date) + 1",
    "days_supply": "days_supply",
    "quantity": "quantity",
    "days_supply_difference": "days_supply - (datediff(drug_exposure_end_date, drug_exposure_start_date) + 1)",
}


def ingredient_records(c: Clinical, ingredients: Sequence[int], sample: int | None = None, seed: int = 0) -> DataFrame:
    """Drug records with ingredient_concept_id, all, or with n_total up to sample of each ingredient in hash order."""
    a = c["concept_ancestor"].where(F.col("ancestor_concept_id").isin(list(ingredients)))
    a = a.select(F.col("ancestor_concept_id").alias("ingredient_concept_id"), F.col("descendant_concept_id").alias("drug_concept_id"))
    r = c["drug_exposure"].join(a, "drug_concept_id")
    if sample is None:
        return r  # totals would cost another pass, and a shuffle of all records by their few ingredients
    total = r.groupBy("ingredient_concept_id").agg(F.count("*").alias("n_total"))
    r = r.join(F.broadcast(total), "ingredient_concept_id")  # one row an ingredient asked for
    # a threshold on a hash keeps about sample records of each without sorting them
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *sorted(c["drug_exposure"].columns))), 1, 10), 16, 10).cast("long")
    return r.where(key < F.ceil(F.lit(float(1 << 40)) * sample / F.col("n_total")))


def _few(value: Column, least: int) -> Column:
    """Counts between 0 and least are not told."""
    return F.when((value == 0) | (value >= least), value)


def check_missing(records: DataFrame, least: int = 5) -> DataFrame:
    """(ingredient_concept_id, variable, n_records, n_missing, share) of every column of the records."""
    cols = [x for x in records.columns if x not in ("ingredient_concept_id", "n_total")]
    one = records.groupBy("ingredient_concept_id").agg(F.count("*").alias("n"), *(F.sum(F.col(x).isNull().cast("long")).alias(x) for x in cols))
    long = one.select("ingredient_concept_id", "n", F.explode(F.array(*(F.struct(F.lit(x).alias("variable"), F.col(x).alias("m")) for x in cols))).alias("v"))
    return long.select("ingredient_concept_id", "v.variable", _few(F.col("n"), least).alias("n_records"), _few(F.col("v.m"), least).alias("n_missing"), F.when((F.col("v.m") == 0) | (F.col("v.m") >= least), F.col("v.m") / F.col("n")).alias("share"))


def check_categorical(records: DataFrame, column: str, least: int = 5) -> DataFrame:
    """(ingredient_concept_id, category, n_records, n_persons)."""
    g = records.groupBy("ingredient_concept_id", F.coalesce(F.col(column).cast("string"), F.lit("missing")).alias("category"))
    return g.agg(_few(F.count("*"), least).alias("n_records"), _few(F.count_distinct("person_id"), least).alias("n_persons"))


def check_numeric(records: DataFrame, expression: str, least: int = 5) -> DataFrame:
    """(ingredient_concept_id, n_records, n_missing, n_negative, min, quantiles, max, mean, sd)."""
    v, by = F.col("_v"), ["ingredient_concept_id"]
    r = records.select(*by, F.expr(f"cast({expression} as double)").alias("_v"))
    plain = r.groupBy(*by).agg(
        _few(F.count("*"), least).alias("n_records"), _few(F.count("*") - F.count(v), least).alias("n_missing"), _few(F.sum((v < 0).cast("long")), least).alias("n_negative"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"),
    )
    names = {f"q{round(q * 100):02d}": q for q in QUANTILES}
    return beside(plain, interpolated(r, by, "_v", names), by).select(*by, "n_records", "n_missing", "n_negative", "min", *names, "max", "mean", "sd")


def check_summary(records: DataFrame, least: int = 5) -> DataFrame:
    """(ingredient_concept_id, n_total, n_sample, n_persons)."""
    counts = [F.count("*").alias("n"), F.count_distinct("person_id").alias("p")]
    if "n_total" in records.columns:
        g = records.groupBy("ingredient_concept_id", "n_total").agg(*counts)
    else:
        g = records.groupBy("ingredient_concept_id").agg(*counts).withColumn("n_total", F.col("n"))
    return g.select("ingredient_concept_id", _few(F.col("n_total"), least).alias("n_total"), _few(F.col("n"), least).alias("n_sample"), _few(F.col("p"), least).alias("n_persons"))


def execute_checks(c: Clinical, ingredients: Sequence[int], checks: Sequence[str] | None = None, sample: int | None = 10_000, least: int = 5) -> dict[str, DataFrame]:
    """One lazy frame for each check: summary, missing, and those of CATEGORICAL and NUMERIC."""
    r = ingredient_records(c, ingredients, sample)
    every = {"summary": lambda: check_summary(r, least), "missing": lambda: check_missing(r, least)}
    every |= {k: (lambda x=x: check_categorical(r, x, least)) for k, x in CATEGORICAL.items()}
    every |= {k: (lambda x=x: check_numeric(r, x, least)) for k, x in NUMERIC.items()}
    return {k: every[k]() for k in (checks or every)}
