"""A cohort with what belongs to it: settings, attrition and codelists, carried along by every step."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eralith.functions.checks import assert_table_columns
from eralith.operators.cohort import COHORT, cohort_counts

_ATTRITION = "cohort_definition_id long, number_records long, number_subjects long, reason_id long, reason string, excluded_records long, excluded_subjects long"
_CODELIST = "cohort_definition_id long, codelist_name string, concept_id long, codelist_type string"


@dataclass(frozen=True)
class CohortTable:
    """Entries and three side tables, all lazy. Absent settings name each cohort cohort_{id}; the others start empty."""

    entries: DataFrame
    settings: DataFrame
    attrition: DataFrame
    codelist: DataFrame

    @classmethod
    def of(cls, entries: DataFrame, settings: DataFrame | None = None, attrition: DataFrame | None = None, codelist: DataFrame | None = None) -> CohortTable:
        assert_table_columns(entries, COHORT, "cohort")
        spark = entries.sparkSession
        if settings is None:
            settings = entries.select(F.col(COHORT[0]).cast("long")).distinct().withColumn("cohort_name", F.concat(F.lit("cohort_"), COHORT[0]))
        empty = lambda schema: spark.createDataFrame([], schema)
        return cls(entries, settings, attrition if attrition is not None else empty(_ATTRITION), codelist if codelist is not None else empty(_CODELIST))

    @property
    def counts(self) -> DataFrame:
        """Records and subjects of every cohort of the settings; 0 where it has no entry."""
        n = self.settings.select(COHORT[0]).join(cohort_counts(self.entries), COHORT[0], "left")
        return n.fillna(0, subset=["number_records", "number_subjects"])

    def cohort_id(self, *names: str) -> DataFrame:
        return self.settings.where(F.col("cohort_name").isin(*names)).select(COHORT[0])

    def filter_cohort_id(self, ids: Sequence[int]) -> CohortTable:
        """The same cohort with some of its ids, in the side tables too."""
        keep = lambda df: df.where(F.col(COHORT[0]).isin(list(ids)))
        return CohortTable(*map(keep, (self.entries, self.settings, self.attrition, self.codelist)))

    def step(self, reason: str, entries: DataFrame) -> CohortTable:
        """What a requirement leaves, with a further row of attrition for each cohort."""
        before = self.counts
        if self.attrition.isEmpty():  # the first step tells how many there were
            start = before.select(COHORT[0], "number_records", "number_subjects", F.lit(1).cast("long").alias("reason_id"), F.lit("Initial qualifying events").alias("reason"), F.lit(0).cast("long").alias("excluded_records"), F.lit(0).cast("long").alias("excluded_subjects"))
        else:
            start = self.attrition
        now = replace(self, entries=entries)
        old = before.select(COHORT[0], F.col("number_records").alias("_r"), F.col("number_subjects").alias("_s"))
        last = start.groupBy(COHORT[0]).agg((F.max("reason_id") + 1).alias("reason_id"))
        row = now.counts.join(old, COHORT[0]).join(last, COHORT[0]).select(
            COHORT[0], "number_records", "number_subjects", "reason_id", F.lit(reason).alias("reason"),
            (F.col("_r") - F.col("number_records")).alias("excluded_records"), (F.col("_s") - F.col("number_subjects")).alias("excluded_subjects"),
        )
        return replace(now, attrition=start.unionByName(row))

    def add_cohort_name(self) -> DataFrame:
        return self.entries.join(F.broadcast(self.settings.select(COHORT[0], "cohort_name")), COHORT[0], "left")
