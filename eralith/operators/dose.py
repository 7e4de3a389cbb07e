"""Daily dose of drug records from the strength of the product, by patterns of units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eralith.functions.sweeps import by_size, point, points
from eralith.sources.clinical import Clinical

#: Unit concepts.
UNITS = {
    "hour": 8505, "unit": 8510, "liter": 8519, "milligram": 8576, "milliliter": 8587, "international unit": 8718,
    "mega-international unit": 9439, "square centimeter": 9483, "milliequivalent": 9551, "microgram": 9655, "actuation": 45744809,
}
#: Number, amount unit, numerator unit, whether there is a denominator value, denominator unit, formula, dose unit; "-": none.
PATTERNS = [
    (1, "-", "microgram", True, "hour", "time based with denominator", "milliequivalent"),
    (2, "-", "milligram", True, "hour", "time based with denominator", "milligram"),
    (3, "-", "unit", True, "hour", "time based with denominator", "international unit"),
    (4, "-", "microgram", False, "hour", "time based no denominator", "milligram"),
    (5, "-", "milligram", False, "hour", "time based no denominator", "milliliter"),
    (6, "international unit", "-", False, "-", "fixed amount formulation", "international unit"),
    (7, "microgram", "-", False, "-", "fixed amount formulation", "milligram"),
    (8, "milliequivalent", "-", False, "-", "fixed amount formulation", "milliequivalent"),
    (9, "milligram", "-", False, "-", "fixed amount formulation", "milligram"),
    (10, "milliliter", "-", False, "-", "fixed amount formulation", "milliliter"),
    (11, "unit", "-", False, "-", "fixed amount formulation", "international unit"),
    (12, "-", "international unit", True, "milligram", "concentration formulation", "international unit"),
    (13, "-", "international unit", True, "milliliter", "concentration formulation", "international unit"),
    (14, "-", "milliequivalent", True, "milliliter", "concentration formulation", "milliequivalent"),
    (15, "-", "milligram", True, "actuation", "concentration formulation", "milligram"),
    (16, "-", "milligram", True, "liter", "concentration formulation", "milligram"),
    (17, "-", "milligram", True, "milligram", "concentration formulation", "milligram"),
    (18, "-", "milligram", True, "milliliter", "concentration formulation", "milligram"),
    (19, "-", "milligram", True, "square centimeter", "concentration formulation", "milligram"),
    (20, "-", "milliliter", True, "milligram", "concentration formulation", "milliliter"),
    (21, "-", "milliliter", True, "milliliter", "concentration formulation", "milliliter"),
    (22, "-", "unit", True, "actuation", "concentration formulation", "international unit"),
    (23, "-", "unit", True, "milligram", "concentration formulation", "international unit"),
    (24, "-", "unit", True, "milliliter", "concentration formulation", "international unit"),
    (25, "-", "unit", True, "square centimeter", "concentration formulation", "international unit"),
    (26, "-", "international unit", False, "milligram", "concentration formulation", "international unit"),
    (27, "-", "international unit", False, "milliliter", "concentration formulation", "international unit"),
    (28, "-", "mega-international unit", False, "milliliter", "concentration formulation", "international unit"),
    (29, "-", "milliequivalent", False, "milligram", "concentration formulation", "milliequivalent"),
    (30, "-", "milliequivalent", False, "milliliter", "concentration formulation", "milliequivalent"),
    (31, "-", "milligram", False, "actuation", "concentration formulation", "milligram"),
    (32, "-", "milligram", False, "liter", "concentration formulation", "milligram"),
    (33, "-", "milligram", False, "milligram", "concentration formulation", "milligram"),
    (34, "-", "milligram", False, "milliliter", "concentration formulation", "milligram"),
    (35, "-", "milligram", False, "square centimeter", "concentration formulation", "milligram"),
    (36, "-", "milliliter", False, "milligram", "concentration formulation", "milliliter"),
    (37, "-", "milliliter", False, "milliliter", "concentration formulation", "milliliter"),
    (38, "-", "unit", False, "actuation", "concentration formulation", "international unit"),
    (39, "-", "unit", False, "milligram", "concentration formulation", "international unit"),
    (40, "-", "unit", False, "milliliter", "concentration formulation", "international unit"),
    (41, "-", "unit", False, "square centimeter", "concentration formulation", "international unit"),
]


def _key(amount: Column, numerator: Column, has_denominator: Column, denominator: Column) -> Column:
    return F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("-")) for c in (amount, numerator, has_denominator, denominator)))


def strength_patterns(strength: DataFrame) -> DataFrame:
    """strength with pattern_id, formula and unit, null where no pattern fits: a look-up in a constant map, no join."""
    unit = lambda n: "-" if n == "-" else str(UNITS[n])
    entries = [x for n, a, num, has, den, formula, out in PATTERNS for x in (F.lit("|".join((unit(a), unit(num), str(int(has)), unit(den)))), F.struct(F.lit(n).alias("pattern_id"), F.lit(formula).alias("formula"), F.lit(out).alias("unit")))]
    # an amount goes without numerator and the other way round
    fits = F.col("amount_value").isNotNull() != F.col("numerator_value").isNotNull()
    same = (F.col("amount_value").isNotNull() == F.col("amount_unit_concept_id").isNotNull()) & (F.col("numerator_value").isNotNull() == F.col("numerator_unit_concept_id").isNotNull())
    key = _key(F.col("amount_unit_concept_id"), F.col("numerator_unit_concept_id"), F.col("denominator_value").isNotNull().cast("int"), F.col("denominator_unit_concept_id"))
    return strength.withColumn("_p", F.when(fits & same, F.try_element_at(F.create_map(*entries), key))).select("*", "_p.*").drop("_p")


def daily_dose(c: Clinical, exposures: DataFrame, ingredient: int | None = None, by_ingredient: bool = False) -> DataFrame:
    """exposures (drug_concept_id, quantity, start and end) with pattern_id, unit and daily_dose; null where it can't be told.

    Micrograms count as milligrams, mega units as units and liters as milliliters. Fixed amounts and concentrations
    spread over the days exposed; an hourly strength over more than 24 hours is brought down to a day. by_ingredient:
    with ingredient_concept_id, and a row for each ingredient of the product.
    """
    s = c["drug_strength"].where(F.col("ingredient_concept_id") == ingredient) if ingredient is not None else c["drug_strength"]
    s = strength_patterns(s)
    v = lambda name, factors: F.coalesce(*(F.when(F.col(f"{name}_unit_concept_id") == UNITS[u], F.col(f"{name}_value") * x) for u, x in factors.items()), F.col(f"{name}_value"))
    s = s.select(
        "drug_concept_id", "pattern_id", "formula", "unit", v("amount", {"microgram": 1e-3}).alias("_a"), v("numerator", {"microgram": 1e-3, "mega-international unit": 1e-6}).alias("_n"),
        v("denominator", {"liter": 1000.0}).alias("_d"), *(["ingredient_concept_id"] if by_ingredient else []),
    )
    d = exposures.join(s, "drug_concept_id", "left")
    days = F.datediff("drug_exposure_end_date", "drug_exposure_start_date") + 1
    known = (F.col("quantity") > 0) & (days > 0)
    dose = (
        F.when(F.col("formula") == "fixed amount formulation", F.when(known & (F.col("_a") > 0), F.col("_a") * F.col("quantity") / days))
        .when(F.col("formula") == "concentration formulation", F.when(known & (F.col("_n") > 0), F.col("_n") * F.col("quantity") / days))
        .when(F.col("formula") == "time based with denominator", F.when((F.col("_n") > 0) & (F.col("_d") > 24), F.col("_n") * 24 / F.col("_d")).when((F.col("_n") > 0) & (F.col("_d") > 0), F.col("_n")))
        .when(F.col("formula") == "time based no denominator", F.when(F.col("_n") > 0, F.col("_n") * 24))
    )
    d = d.withColumn("daily_dose", dose.cast("double"))
    return d.withColumn("unit", F.when(F.col("daily_dose").isNotNull(), F.col("unit"))).drop("_a", "_n", "_d", "formula")


def pattern_coverage(c: Clinical, ingredient: int | None = None) -> DataFrame:
    """(pattern_id, unit, n_records, n_missing_quantity, mean_dose) of the records of an ingredient."""
    d = daily_dose(c, c["drug_exposure"], ingredient)
    if ingredient is not None:
        d = d.join(c["drug_strength"].where(F.col("ingredient_concept_id") == ingredient).select("drug_concept_id").distinct(), "drug_concept_id", "left_semi")
    return d.groupBy("pattern_id").agg(F.max("unit").alias("unit"), F.count("*").alias("n_records"), F.sum(F.col("quantity").isNull().cast("long")).alias("n_missing_quantity"), F.avg("daily_dose").alias("mean_dose"))


#: What doses are added up in, so that a dose that is taken away leaves exactly the rest.
_EXACT = "decimal(28,6)"


def dose_eras(c: Clinical, gap: int = 30) -> DataFrame:
    """(dose_era_id, person_id, drug_concept_id, unit_concept_id, dose_value, dose_era_start_date, dose_era_end_date).

    An era is a time over which a person takes one and the same daily dose of an ingredient in a unit. Doses of exposures that
    run at once add up (to six decimals), so an era ends where any of them starts or stops and the sum changes; eras of an equal
    dose with at most gap days without any between them are one. Exposures whose dose can't be told are left out, those
    without an end last a day. One sweep over starts and ends: exposures are dealt out once, into parts whose number grows with
    the input, and all that follows runs along one sort of their points.
    """
    keys = ["person_id", "drug_concept_id", "unit_concept_id"]
    unit = F.create_map(*(F.lit(x) for n, i in UNITS.items() for x in (n, int(i)))).cast("map<string,bigint>")
    start, end = F.col("drug_exposure_start_date"), F.greatest(F.coalesce("drug_exposure_end_date", "drug_exposure_start_date"), "drug_exposure_start_date")
    e = c["drug_exposure"].select("person_id", "drug_concept_id", "quantity", "drug_exposure_start_date", end.alias("drug_exposure_end_date"))
    e = daily_dose(c, e, by_ingredient=True).where("daily_dose is not null and person_id is not null")
    e = e.select("person_id", F.col("ingredient_concept_id").alias("drug_concept_id"), unit[F.col("unit")].alias("unit_concept_id"), F.col("daily_dose").cast(_EXACT).alias("dose"), "drug_exposure_start_date", "drug_exposure_end_date")
    pts = points(by_size(e, *keys), keys, point(start, dose=F.col("dose"), n=1), point(F.date_add("drug_exposure_end_date", 1), dose=-F.col("dose"), n=-1))
    w = Window.partitionBy(*keys).orderBy("day")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    # of the points of a day the last one has the sums of them all
    runs = pts.withColumns({"dose": F.sum("dose").over(upto), "n": F.sum("n").over(upto), "next": F.lead("day").over(w)}).where("next > day and n > 0")
    runs = runs.withColumn("end", F.date_sub("next", 1))
    goes_on = (F.lag("dose").over(w) == F.col("dose")) & (F.col("day") <= F.date_add(F.lag("end").over(w), gap + 1))
    runs = runs.withColumn("_new", F.when(goes_on, False).otherwise(True))
    # an era's first and last stretch stand side by side once those between are gone
    runs = runs.withColumn("_last", F.coalesce(F.lead("_new").over(w), F.lit(True))).where("_new or _last")
    runs = runs.withColumn("end", F.when(F.col("_last"), F.col("end")).otherwise(F.lead("end").over(w)))
    eras = runs.where("_new").select(*keys, F.col("day").alias("start"), "end", F.col("dose").cast("double").alias("dose_value"))
    return eras.select(
        F.xxhash64(*keys, "start").alias("dose_era_id"), *keys, "dose_value", F.col("start").alias("dose_era_start_date"), F.col("end").alias("dose_era_end_date"),
    )
