"""Sweeps over a person's days: state that changes at points in time, as running sums in one sorted pass.

Points of one person and day are added up before they are shuffled, so what a sweep sorts for a person is bounded by the days of
the person's history, however many records there are; windows run through it as a stream and may spill.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ends of time, for windows without a bound.
FIRST_DAY, LAST_DAY = "0001-01-01", "9999-12-31"


def point(day: Column, **changes: Column | int) -> Column:
    """A point of a sweep: what is added to each sum from this day on."""
    return F.struct(day.cast("date").alias("day"), *((F.lit(v) if isinstance(v, int) else v).alias(k) for k, v in changes.items()))


def points(df: DataFrame, keys: Sequence[str], *changes: Column) -> DataFrame:
    """(keys..., day, sums...): the points of each row; all must have the same sums. Points without a day never come."""
    return df.select(*keys, F.inline(F.array(*changes))).where("day is not null")


def segments(pts: DataFrame, keys: Sequence[str], sums: Sequence[str], also: Mapping[str, Column] | None = None) -> DataFrame:
    """(keys..., start, end, sums...): the stretches of days between points, with what has been added up so far.

    A point bounds stretches even if it changes nothing. What lies behind a key's last point is not a stretch. also: further
    aggregates of the points of one day, by name.
    """
    day = pts.groupBy(*keys, "day").agg(*(F.sum(s).alias(s) for s in sums), *(c.alias(n) for n, c in (also or {}).items()))
    w = Window.partitionBy(*keys).orderBy("day")
    running = {s: F.sum(s).over(w.rowsBetween(Window.unboundedPreceding, 0)) for s in sums}
    out = day.withColumns({**running, "end": F.date_sub(F.lead("day").over(w), 1)}).where("end is not null")
    return out.select(*keys, F.col("day").alias("start"), "end", *sums, *(also or {}))


#: Bytes of input for each part of what is sorted row by row.
BYTES_A_PART = 4 << 20


def parts(*dfs: DataFrame) -> int | None:
    """How many parts the tables that all frames read make; None where a table's size is not known, as of one in memory."""
    plans = [df._jdf.queryExecution().optimizedPlan().collectLeaves() for df in dfs]
    size = sum(int(str(p.apply(i).stats().sizeInBytes())) for p in plans for i in range(p.size()))
    return None if size >= 1 << 60 else -(-size // BYTES_A_PART)


def by_size(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by the keys, into parts whose number grows with the tables that it reads: so their size does not.

    Where that is not known it is the session's number of parts.
    """
    n = parts(df)
    return df.repartition(*keys) if n is None else df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism), *keys)


def both_by_size(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> tuple[DataFrame, DataFrame]:
    """Two frames that an equality of the keys joins, dealt out alike by their size; small ones stay as they are, for a broadcast.

    Never into fewer parts than the session's: the join would deal them out once more.
    """
    spark = left.sparkSession
    n = parts(left, right)
    if n is None or n <= 4 * spark.sparkContext.defaultParallelism:
        return left, right
    n = max(n, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return left.repartition(n, left_key), right.repartition(n, right_key)


def overlap_totals(entries: DataFrame, events: DataFrame, windows: Sequence[tuple[int | None, int | None]], key: str, index: str) -> DataFrame:
    """(key, index, n_0, first_0, n_1, ...): of each distinct entry and window, how many events overlap it and the least start.

    entries: (key, index); events: (key, start, end), those that end before they start are left out; a window (lo, hi) are the
    days from index + lo to index + hi, None is no bound. No entry meets an event: those that overlap a window are those
    that start until its end less those that end before it begins, as an event that has ended has started; both are
    running counts. The least start is the running minimum over ends from the last to the window's first day, if it is
    not past the window.
    """
    if any(lo is not None and hi is not None and lo > hi for lo, hi in windows):
        raise ValueError("a window must not end before it begins")
    ids = entries.select(F.col(key).alias("_k"), F.col(index).alias("_at")).where("_k is not null and _at is not null").distinct()
    e = events.select(F.col(key).alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e")).where("_s <= _e")
    e = e.join(ids.select("_k").distinct(), "_k", "left_semi")
    # axis 0: starts, axis 1: ends; ord: whether a point of a day comes before or after what is asked on that day
    both = F.inline(F.array(F.struct(F.lit(0).alias("axis"), F.col("_s").alias("day"), F.lit(0).alias("ord")), F.struct(F.lit(1).alias("axis"), F.col("_e").alias("day"), F.lit(1).alias("ord"))))
    happened = e.select("_k", "_s", both).groupBy("_k", "axis", "day", "ord").agg(F.count("*").alias("n"), F.min("_s").alias("first"))
    asked = []
    for i, (lo, hi) in enumerate(windows):
        days = (F.lit(LAST_DAY).cast("date") if hi is None else F.date_add("_at", hi)), (F.lit(FIRST_DAY).cast("date") if lo is None else F.date_add("_at", lo))
        asked += [F.struct(F.lit(axis).alias("axis"), d.alias("day"), F.lit(1 - axis).alias("ord"), F.lit(i).alias("i")) for axis, d in enumerate(days)]
    asks = ids.select("_k", "_at", F.inline(F.array(*asked))).select("_k", "axis", "day", "ord", F.lit(0).cast("long").alias("n"), F.lit(None).cast("date").alias("first"), "_at", "i")
    every = happened.select("*", F.lit(None).cast(ids.schema["_at"].dataType).alias("_at"), F.lit(None).cast("int").alias("i")).unionByName(asks).repartition("_k")
    up = Window.partitionBy("_k", "axis").orderBy("day", "ord").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("_k", "axis").orderBy(F.desc("day"), F.desc("ord")).rowsBetween(Window.unboundedPreceding, 0)
    told = every.withColumns({"until": F.sum("n").over(up), "least": F.min("first").over(down)}).where("i is not null")
    aggs = []
    for i in range(len(windows)):
        mine = lambda axis, c, i=i: F.when((F.col("i") == i) & (F.col("axis") == axis), F.col(c))
        aggs += [(F.sum(mine(0, "until")) - F.sum(mine(1, "until"))).alias(f"n_{i}"), F.min(mine(1, "least")).alias(f"first_{i}")]
    out = told.groupBy("_k", "_at").agg(*aggs)
    for i, (_, hi) in enumerate(windows):
        if hi is not None:
            out = out.withColumn(f"first_{i}", F.when(F.col(f"first_{i}") <= F.date_add("_at", hi), F.col(f"first_{i}")))
    return out.withColumnsRenamed({"_k": key, "_at": index})
