"""Person-level enrichment around an index date: demographics, observation, intersections, categories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eralith.functions.kernels import in_window, packed_age
from eralith.functions.sweeps import overlap_totals
from eralith.sources.clinical import Clinical

Window_ = tuple[int | None, int | None]


def _person(df: DataFrame) -> str:
    return "subject_id" if "subject_id" in df.columns else "person_id"


def birth_date() -> Column:
    return F.make_date("year_of_birth", F.coalesce("month_of_birth", F.lit(1)), F.coalesce("day_of_birth", F.lit(1)))


def add_concept_name(c: Clinical, df: DataFrame, *columns: str) -> DataFrame:
    """{column}_name of each concept column; without columns, of all that end in _concept_id."""
    for column in columns or [x for x in df.columns if x.endswith("_concept_id")]:
        names = c["concept"].select(F.col("concept_id").alias("_c"), F.col("concept_name").alias(f"{column}_name"))
        df = df.join(names, F.col(column) == F.col("_c"), "left").drop("_c")
    return df


def add_cdm_name(c: Clinical, df: DataFrame) -> DataFrame:
    return df.withColumn("cdm_name", F.lit(c.name))


def filter_cohort_id(cohort: DataFrame, ids: Sequence[int]) -> DataFrame:
    return cohort.where(F.col("cohort_definition_id").isin(list(ids)))


def add_demographics(c: Clinical, df: DataFrame, index: str = "cohort_start_date") -> DataFrame:
    """age, gender_concept_id, sex, prior_observation, future_observation (null outside observation)."""
    who = _person(df)
    p = c["person"].select(F.col("person_id").alias(who), "gender_concept_id", birth_date().alias("_birth"))
    op = c["observation_period"].select(F.col("person_id").alias("_p"), F.col("observation_period_start_date").alias("_s"), F.col("observation_period_end_date").alias("_e"))
    d = df.join(p, who, "left").join(op, (F.col(who) == F.col("_p")) & F.col(index).between(F.col("_s"), F.col("_e")), "left")
    return d.withColumns({
        "age": packed_age(F.col("_birth"), F.col(index)),
        "sex": F.when(F.col("gender_concept_id") == 8507, "Male").when(F.col("gender_concept_id") == 8532, "Female").otherwise("None"),
        "prior_observation": F.datediff(index, "_s"), "future_observation": F.datediff("_e", index),
    }).drop("_birth", "_p", "_s", "_e")


def add_in_observation(c: Clinical, df: DataFrame, index: str = "cohort_start_date", window: Window_ = (0, 0)) -> DataFrame:
    """in_observation: whether one observation period covers the whole window around the index."""
    who = _person(df)
    lo, hi = (F.date_add(index, w or 0) for w in window)
    op = c["observation_period"].select(F.col("person_id").alias("_p"), F.col("observation_period_start_date").alias("_s"), F.col("observation_period_end_date").alias("_e"))
    on = (F.col(who) == F.col("_p")) & (F.col("_s") <= lo) & (F.col("_e") >= hi)
    ids = df.select(who, index).distinct().join(op, on, "left_semi").withColumn("_in", F.lit(1))
    return df.join(ids, [who, index], "left").withColumn("in_observation", F.coalesce("_in", F.lit(0))).drop("_in")


def add_category(df: DataFrame, column: str, groups: Mapping[str, tuple[float | None, float | None]], name: str, missing: str = "None") -> DataFrame:
    """name: label of the first range (inclusive) that holds the value."""
    label = F.lit(None).cast("string")
    for text, (lo, hi) in reversed(groups.items()):
        test = F.col(column).isNotNull()
        test = test & (F.col(column) >= lo) if lo is not None else test
        test = test & (F.col(column) <= hi) if hi is not None else test
        label = F.when(test, text).otherwise(label)
    return df.withColumn(name, F.coalesce(label, F.lit(missing)))


def add_intersect(
    df: DataFrame, events: DataFrame, windows: Sequence[Window_], index: str = "cohort_start_date", name: str = "event",
    start: str = "start_date", end: str = "end_date", what: Sequence[str] = ("flag", "count", "date", "days"), person: str = "person_id",
) -> DataFrame:
    """For each window: whether, how often, when first and how many days away a person's events overlap it.

    Entries and events never meet: running counts along each person's days answer all windows in one sweep, so a person with
    very many of both costs no more than their days. Events that end before they start are left out. Columns are
    {name}_{what}_{lo}_{hi}; m before a number stands for minus, inf for no bound.
    """
    who = _person(df)
    label = lambda w: "_".join("minf" if v is None and k == 0 else "inf" if v is None else f"m{-v}" if v < 0 else str(v) for k, v in enumerate(w))
    e = events.select(F.col(person).alias(who), F.col(start).alias("start"), F.coalesce(end, start).alias("end"))
    found = overlap_totals(df.select(who, index), e, windows, who, index)
    found = found.withColumnsRenamed({f"{c}_{i}": f"{name}_{n}_{label(w)}" for i, w in enumerate(windows) for c, n in (("n", "count"), ("first", "date"))})
    out = df.join(found, [who, index], "left")
    for w in windows:
        n, d = F.coalesce(F.col(f"{name}_count_{label(w)}"), F.lit(0)), F.col(f"{name}_date_{label(w)}")
        new = {"count": n.cast("long"), "flag": (n > 0).cast("int"), "date": d, "days": F.datediff(d, index)}
        out = out.withColumns({f"{name}_{k}_{label(w)}": v for k, v in new.items() if k != "date"})
        out = out.drop(*(f"{name}_{k}_{label(w)}" for k in new if k not in what))
    return out


def add_cohort_intersect(df: DataFrame, cohort: DataFrame, windows: Sequence[Window_], name: str = "cohort", **more) -> DataFrame:
    return add_intersect(df, cohort, windows, name=name, start="cohort_start_date", end="cohort_end_date", person="subject_id", **more)


def add_concept_intersect(c: Clinical, df: DataFrame, concepts: Mapping[str, Sequence[int]], windows: Sequence[Window_], **more) -> DataFrame:
    from eralith.operators.cohort import concept_events

    for name, ids in concepts.items():
        df = add_intersect(df, concept_events(c, {name: ids}), windows, name=name, **more)
    return df


def add_death(c: Clinical, df: DataFrame, index: str = "cohort_start_date", window: Window_ = (0, None)) -> DataFrame:
    """death (0/1) and days_to_death within the window."""
    death = c["death"].select("person_id", F.col("death_date").alias("start_date"), F.col("death_date").alias("end_date"))
    return add_intersect(df, death, [window], index=index, name="death", what=("flag", "days"))


def add_cohort_name(df: DataFrame, names: Mapping[int, str]) -> DataFrame:
    table = F.create_map(*(F.lit(x) for k, v in names.items() for x in (k, v)))
    return df.withColumn("cohort_name", table[F.col("cohort_definition_id").cast("int")])


def add_date_of_birth(c: Clinical, df: DataFrame) -> DataFrame:
    who = _person(df)
    return df.join(c["person"].select(F.col("person_id").alias(who), birth_date().alias("date_of_birth")), who, "left")


def add_observation_period(c: Clinical, df: DataFrame, index: str = "cohort_start_date") -> DataFrame:
    """observation_period_number (by start within the person), and its start and end, of the period that holds the index."""
    from pyspark.sql import Window

    who = _person(df)
    w = Window.partitionBy("person_id").orderBy("observation_period_start_date", "observation_period_end_date")
    op = c["observation_period"].select(F.col("person_id").alias("_p"), F.row_number().over(w).alias("observation_period_number"), "observation_period_start_date", "observation_period_end_date")
    on = (F.col(who) == F.col("_p")) & F.col(index).between(F.col("observation_period_start_date"), F.col("observation_period_end_date"))
    return df.join(op, on, "left").drop("_p")


def add_record_order(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """record_number within each key, days_from_previous and days_to_next record by the first order column."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumns({"record_number": F.row_number().over(w), "days_from_previous": F.datediff(order[0], F.lag(order[0]).over(w)), "days_to_next": F.datediff(F.lead(order[0]).over(w), order[0])})
    return d


def add_intersect_field(df: DataFrame, events: DataFrame, field: str, window: Window_, index: str = "cohort_start_date", last: bool = False, name: str = "value") -> DataFrame:
    """name: field of a person's first (or last) event in the window, by start, end and the field itself."""
    who = _person(df)
    e = events.select(F.col("person_id").alias("_p"), F.col("start_date").alias("_s"), F.coalesce("end_date", "start_date").alias("_e"), F.col(field).alias("_f"))
    ids = df.select(who, index).distinct()
    hit = ids.join(e, (F.col(who) == F.col("_p")) & in_window(F.col(index), F.col("_s"), F.col("_e"), window))
    pick = (F.max if last else F.min)(F.struct("_s", "_e", "_f"))
    return df.join(hit.groupBy(who, index).agg(pick.alias("_x")).select(who, index, F.col("_x._f").alias(name)), [who, index], "left")
