"""Summaries of cohorts in long form: counts, characteristics, timing, overlap, large scale, quantiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eralith.functions.kernels import in_window
from eralith.functions.quantiles import at_ranks, beside, interpolated, lowest_at, nearest_index


def numeric_estimates(df: DataFrame, by: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """(by..., variable, min, q25, median, q75, max, mean, sd, n_missing): one unpivot, one aggregate for all variables.

    Quartiles are values that occur, the median the middle of the two next to it; both are exact and no buffer holds a group.
    """
    long = df.select(*by, F.explode(F.array(*(F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in variables))).alias("_v")).select(*by, "_v.*")
    known = ["min", "q25", "median", "q75", "max", "mean", "sd", "n_missing"]
    v = F.col("value")
    plain = long.groupBy(*by, "variable").agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), (F.count("*") - F.count(v)).alias("n_missing"))
    middle = interpolated(long, [*by, "variable"], "value", {"median": 0.5}, {"q25": lowest_at(0.25), "q75": lowest_at(0.75)})
    return beside(plain, middle, [*by, "variable"]).select(*by, "variable", *known)


def categorical_estimates(df: DataFrame, by: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """(by..., variable, level, count, percentage of the group's rows)."""
    long = df.select(*by, F.explode(F.array(*(F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("level")) for v in variables))).alias("_v")).select(*by, "_v.*")
    n = long.groupBy(*by, "variable", "level").agg(F.count("*").alias("count"))
    total = n.groupBy(*by, "variable").agg(F.sum("count").alias("_n"))
    return n.join(total, [*by, "variable"]).withColumn("percentage", F.col("count") * 100 / F.col("_n")).drop("_n")


def strata_counts(cohort: DataFrame, strata: Sequence[Sequence[str]]) -> DataFrame:
    """Records and subjects overall and for each combination of strata columns: grouping sets over one scan."""
    columns = sorted({c for s in strata for c in s})
    sets = [["cohort_definition_id"], *(["cohort_definition_id", *s] for s in strata)]
    g = cohort.groupingSets([[F.col(x) for x in s] for s in sets], "cohort_definition_id", *columns)
    return g.agg(F.count("*").alias("number_records"), F.count_distinct("subject_id").alias("number_subjects"), F.grouping_id().cast("long").alias("grouping"))


def cohort_overlap(cohort: DataFrame) -> DataFrame:
    """Ordered pairs of cohorts: subjects only in the first, only in the second, in both.

    A subject's cohorts form a small set, so pairs come from sets per subject and not from a join of subjects.
    """
    sets = cohort.groupBy("subject_id").agg(F.collect_set("cohort_definition_id").alias("_s"))
    alone = sets.select(F.explode("_s").alias("a")).groupBy("a").agg(F.count("*").alias("n"))
    pairs = sets.select(F.explode("_s").alias("a"), "_s").select("a", F.explode("_s").alias("b")).where("a != b").groupBy("a", "b").agg(F.count("*").alias("both"))
    # one row a cohort on either side
    grid = alone.select(F.col("a"), F.col("n").alias("n_a")).join(alone.select(F.col("a").alias("b"), F.col("n").alias("n_b")), F.col("a") != F.col("b"))
    d = grid.join(pairs, ["a", "b"], "left").fillna(0, subset=["both"])
    return d.select(F.col("a").alias("cohort_a"), F.col("b").alias("cohort_b"), (F.col("n_a") - F.col("both")).alias("only_a"), (F.col("n_b") - F.col("both")).alias("only_b"), "both")


def cohort_timing(cohort: DataFrame) -> DataFrame:
    """Days between the first entries of subjects in two cohorts: (cohort_a, cohort_b, n, min, mean, max)."""
    first = cohort.groupBy("subject_id", "cohort_definition_id").agg(F.min("cohort_start_date").alias("s"))
    sets = first.groupBy("subject_id").agg(F.collect_list(F.struct("cohort_definition_id", "s")).alias("_s"))
    p = sets.select(F.explode("_s").alias("x"), "_s").select("x", F.explode("_s").alias("y")).where("x.cohort_definition_id != y.cohort_definition_id")
    days = F.datediff("y.s", "x.s")
    return p.groupBy(F.col("x.cohort_definition_id").alias("cohort_a"), F.col("y.cohort_definition_id").alias("cohort_b")).agg(F.count("*").alias("n"), F.min(days).alias("min_days"), F.avg(days).alias("mean_days"), F.max(days).alias("max_days"))


#: Windows that one number holds a bit each of.
_BITS = 62


def large_scale(cohort: DataFrame, events: DataFrame, windows: Sequence[tuple[int | None, int | None]], minimum: float = 0.0) -> DataFrame:
    """Per cohort, window and concept: entries with the concept in the window, and their share of all entries.

    An entry and a concept are one row with a bit for each window in which the concept occurs, whatever the number of events and
    windows; entries are then counted by bit. No event is multiplied by the windows that it lies in.
    """
    keys = ["cohort_definition_id", "subject_id", "cohort_start_date"]
    e = events.select(F.col("person_id").alias("_p"), "concept_id", F.col("start_date").alias("_s"), F.col("end_date").alias("_e")).where("concept_id is not null")
    hit = cohort.select(*keys).join(e, F.col("subject_id") == F.col("_p"))
    tests = [in_window(F.col("cohort_start_date"), F.col("_s"), F.col("_e"), w) for w in windows]
    groups = range(0, len(windows), _BITS)
    bits = [sum((F.when(t, 1 << i).otherwise(0).cast("long") for i, t in enumerate(tests[g : g + _BITS])), F.lit(0).cast("long")).alias(f"_b{g}") for g in groups]
    held = hit.select(*keys, "concept_id", *bits).groupBy(*keys, "concept_id").agg(*(F.bit_or(f"_b{g}").alias(f"_b{g}") for g in groups))
    bit = lambda i: F.shiftright(F.col(f"_b{i // _BITS * _BITS}"), i % _BITS).bitwiseAND(1)
    n = held.groupBy("cohort_definition_id", "concept_id").agg(*(F.sum(bit(i)).alias(f"_n{i}") for i in range(len(windows))))
    total = cohort.groupBy("cohort_definition_id").agg(F.count("*").alias("_all"))
    n = n.join(total, "cohort_definition_id")
    label = lambda w: f"{'-inf' if w[0] is None else w[0]} to {'inf' if w[1] is None else w[1]}"
    # the counts are an exchange that all windows' rows are read from
    one = lambda i, w: n.where(F.col(f"_n{i}") > 0).select("cohort_definition_id", F.lit(label(w)).alias("window"), "concept_id", F.col(f"_n{i}").alias("count"), "_all")
    long = reduce(DataFrame.unionByName, [one(i, w) for i, w in enumerate(windows)])
    return long.withColumn("percentage", F.col("count") * 100 / F.col("_all")).drop("_all").where(F.col("percentage") >= minimum)


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Inverse-CDF quantiles, exact, as q{percent}_{column}; the columns' values are ordered as doubles."""
    long = df.select(*by, F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in columns))).alias("_v")).select(*by, "_v.*")
    found = at_ranks(long, [*by, "variable"], "value", {f"q{i}": lowest_at(p) for i, p in enumerate(probs)})
    pick = lambda c, i: F.max(F.when(F.col("variable") == c, F.col(f"q{i}"))).cast(df.schema[c].dataType)
    out = found.groupBy(*by).agg(*(pick(c, i).alias(f"q{round(p * 100):02d}_{c}") for c in columns for i, p in enumerate(probs)))
    # a group without any value has a row all the same
    return beside(df.groupBy(*by).agg(F.count("*").alias("_rows")), out, by).drop("_rows") if by else out


def nearest_quantiles(df: DataFrame, column: str, probs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Quantiles by the nearest index of the sorted values."""
    return at_ranks(df, by, column, {f"q{round(p * 100):02d}_{column}": nearest_index(p) for p in probs}).drop("_of")
