"""The six kernels of cohort analytics, as DataFrame compositions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def closure(seeds: DataFrame, ancestor: DataFrame, excluding: bool = True) -> DataFrame:
    """K1. (name, concept_id) of seeds (name, concept_id, include_descendants, is_excluded): included less excluded.

    excluding: whether any seed may be an excluded one.
    """
    down = (
        seeds.where("include_descendants").join(ancestor, seeds["concept_id"] == ancestor["ancestor_concept_id"])
        .select("name", F.col("descendant_concept_id").alias("concept_id"), "is_excluded")
    )
    every = seeds.select("name", "concept_id", "is_excluded").unionByName(down)
    if not excluding:
        return every.select("name", "concept_id").distinct()
    out = every.where("is_excluded").select("name", "concept_id").distinct()
    return every.where("not is_excluded").select("name", "concept_id").distinct().join(out, ["name", "concept_id"], "left_anti")


def in_window(index: Column, start: Column, end: Column, window: tuple[int | None, int | None]) -> Column:
    """K2. Whether an event overlaps the days (lo, hi) around the index; None is unbounded."""
    lo, hi = window
    test = F.lit(True)
    if lo is not None:
        test = test & (end >= F.date_add(index, lo))
    if hi is not None:
        test = test & (start <= F.date_add(index, hi))
    return test


def islands(df: DataFrame, keys: Sequence[str], start: str, end: str, gap: int = 0) -> DataFrame:
    """K3. Intervals that start no later than gap days after all earlier ones ended, merged: one window, one aggregate."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(F.date_add(end, gap)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = (before.isNull() | (F.col(start) > before)).cast("int")
    d = df.select(*keys, start, end).withColumn("_new", new)
    d = d.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def pick(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], last: bool = False) -> DataFrame:
    """K4. The first (or last) row of each key by a total order."""
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    w = Window.partitionBy(*keys).orderBy(*(c.desc() if last else c.asc() for c in cols))
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def calendar(start: Column, end: Column, unit: str) -> Column:
    """K5. Array of (start, end) of the calendar weeks, months, quarters or years that a range touches, or the range."""
    if unit == "overall":
        return F.array(F.struct(start.alias("start"), end.alias("end")))
    step = {"weeks": "interval 7 days", "months": "interval 1 month", "quarters": "interval 3 months", "years": "interval 1 year"}[unit]
    trunc = {"weeks": "week", "months": "month", "quarters": "quarter", "years": "year"}[unit]
    begins = F.sequence(F.trunc(start, trunc), F.trunc(end, trunc), F.expr(step))
    last = {"weeks": lambda d: F.date_add(d, 6), "months": F.last_day, "quarters": lambda d: F.last_day(F.add_months(d, 2)), "years": lambda d: F.last_day(F.add_months(d, 11))}[unit]
    return F.transform(begins, lambda d: F.struct(d.alias("start"), last(d).alias("end")))


def overlap_days(start: Column, end: Column, lo: Column, hi: Column) -> Column:
    return F.datediff(F.least(end, hi), F.greatest(start, lo)) + 1


def nearest_rank(values: Column, q: float) -> Column:
    """K6. Quantile of a sorted array by the nearest index."""
    return F.element_at(values, (F.round((F.size(values) - 1) * q) + 1).cast("int"))


def packed_age(birth: Column, at: Column) -> Column:
    """Completed years by packed dates."""
    pack = lambda d: F.year(d) * 10000 + F.month(d) * 100 + F.day(d)
    return F.floor((pack(at) - pack(birth)) / 10000).cast("int")


def wilson(events: Column, n: Column) -> tuple[Column, Column]:
    """95 % limits of a proportion."""
    p, z2 = events / n, Z95**2
    middle, half = (p + z2 / (2 * n)) / (1 + z2 / n), Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)


def date_add_interval(date: Column, n: Column | int, unit: str = "day") -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.date_add(date, n) if unit == "day" else F.add_months(date, n * (12 if unit == "year" else 1))


def date_diff_interval(start: Column, end: Column, unit: str = "day") -> Column:
    """Days, or completed months and years by packed dates."""
    if unit == "day":
        return F.datediff(end, start)
    months = lambda d: F.year(d) * 1200 + F.month(d) * 100 + F.day(d)
    return F.floor((months(end) - months(start)) / 100).cast("int") if unit == "month" else packed_age(start, end)
