"""Exact quantiles in bounded memory: a histogram finds the bucket that holds a rank, and only that bucket's values are ordered.

Equal values are counted before they are shuffled. Buckets follow the order of the values and are some 0.3 % wide, so a group's
histogram has some thousand rows whatever the group's size, and a rank's bucket holds a small share of its values. No buffer
grows with a group: counts are hash aggregates, running sums are windows that may spill.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets between a value and its double; the bucket that is further out than that of any finite value.
PER_DOUBLING, _FAR = 256, 1 << 20


def bucket(value: Column) -> Column:
    """The number of a value's bucket; it never falls as values rise. Not-a-number comes last, as in Spark's order."""
    v = value.cast("double")
    size = F.floor(F.log2(F.abs(v)) * PER_DOUBLING).cast("int") + _FAR // 2
    side = F.when(v == 0, 0).when(v == float("inf"), _FAR).when(v == float("-inf"), -_FAR).otherwise(F.signum(v).cast("int") * size)
    return F.when(F.isnan(v), _FAR + 1).otherwise(side)


def at_ranks(df: DataFrame, by: Sequence[str], value: str, ranks: Mapping[str, Column]) -> DataFrame:
    """(by..., names..., _of): of each group the value at each rank, from 1, and the number of its values.

    ranks: name -> rank as an expression of the column _of; null where there is no such rank. Null values don't count; groups
    without any are left out. Keys may be null.
    """
    counted = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v")).groupBy(*by, "_v").agg(F.count("*").alias("_n")).withColumn("_b", bucket(F.col("_v")))
    w = Window.partitionBy(*by)
    hist = counted.groupBy(*by, "_b").agg(F.sum("_n").alias("_m"))
    hist = hist.withColumns({"_upto": F.sum("_m").over(w.orderBy("_b")), "_of": F.sum("_m").over(w)})
    wanted = {f"_r{i}": F.when((rank > F.col("_upto") - F.col("_m")) & (rank <= F.col("_upto")), rank) for i, rank in enumerate(ranks.values())}
    hist = hist.withColumns(wanted).where(F.coalesce(*wanted).isNotNull())
    here = hist.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(by)), F.col("_b").alias("_c"), (F.col("_upto") - F.col("_m")).alias("_before"), "_of", *wanted)
    # null-safe though never null: a test for null would be pushed below the counts, which the histogram then could not share
    on = F.col("_b").eqNullSafe(F.col("_c"))
    for i, k in enumerate(by):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = F.col("_before") + F.sum("_n").over(Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = counted.join(here, on).withColumn("_at", inside)
    return found.groupBy(*by).agg(*(F.min(F.when(F.col("_at") >= F.col(r), F.col("_v"))).alias(name) for name, r in zip(ranks, wanted, strict=True)), F.max("_of").alias("_of"))


def lowest_at(q: float) -> Column:
    """Rank of the least value that a share q of the values does not exceed."""
    return F.greatest(F.ceil(F.col("_of") * F.lit(q)), F.lit(1)).cast("long")


def nearest_index(q: float) -> Column:
    """Rank of the value at the nearest index of the sorted values."""
    return (F.round((F.col("_of") - 1) * F.lit(q)) + 1).cast("long")


def interpolated(df: DataFrame, by: Sequence[str], value: str, shares: Mapping[str, float], more: Mapping[str, Column] | None = None) -> DataFrame:
    """(by..., names...): quantiles between the two values next to them, weighted by nearness; and values at more ranks."""
    place = lambda q: (F.col("_of") - 1) * F.lit(q)
    ends = {f"_{side}{i}": (f(place(q)) + 1).cast("long") for i, q in enumerate(shares.values()) for side, f in (("lo", F.floor), ("hi", F.ceil))}
    out = at_ranks(df, by, value, ends | dict(more or {}))
    for i, (name, q) in enumerate(shares.items()):
        lo, hi, part = F.col(f"_lo{i}").cast("double"), F.col(f"_hi{i}").cast("double"), place(q) - F.floor(place(q))
        out = out.withColumn(name, F.when(part == 0, lo).otherwise(lo * (1 - part) + hi * part))
    return out.select(*by, *shares, *(more or {}))


def beside(df: DataFrame, found: DataFrame, by: Sequence[str]) -> DataFrame:
    """df with found's columns by keys that may be null, each of them once in found."""
    keys = {k: f"_k{i}" for i, k in enumerate(by)}
    f = found.withColumnsRenamed(keys)
    on = F.lit(True)
    for k, other in keys.items():
        on = on & F.col(k).eqNullSafe(F.col(other))
    return df.join(f, on, "left").drop(*keys.values())
