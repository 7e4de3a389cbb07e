"""The clinical tables that the engine works on, and readers and writers for them.

``project`` presents the driver's order tables as clinical tables. Each projection is one SELECT that Spark SQL and
DuckDB both run, so the oracle repeats it word for word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eralith.functions.sweeps import both_by_size

#: Clinical table -> SELECT over the driver's tables (in braces).
PROJECTIONS = {
    "person": """
        SELECT c_custkey AS person_id, CAST(CASE WHEN c_custkey % 2 = 0 THEN 8507 ELSE 8532 END AS BIGINT) AS gender_concept_id,
               CAST(1930 + c_custkey % 60 AS INT) AS year_of_birth, CAST(1 + c_custkey % 12 AS INT) AS month_of_birth,
               CAST(1 + c_custkey % 28 AS INT) AS day_of_birth, CAST(c_nationkey AS BIGINT) AS location_id
        FROM {customer}""",
    "observation_period": """
        SELECT o_custkey AS person_id, MIN(CAST(o_orderdate AS DATE)) AS observation_period_start_date,
               MAX(CAST(o_orderdate AS DATE)) AS observation_period_end_date
        FROM {orders} GROUP BY o_custkey""",
    "visit_occurrence": """
        SELECT o_orderkey AS visit_occurrence_id, o_custkey AS person_id, CAST(9200 + CAST(substr(o_orderpriority, 1, 1) AS INT) AS BIGINT) AS visit_concept_id,
               CAST(o_orderdate AS DATE) AS visit_start_date, CAST(o_orderdate AS DATE) AS visit_end_date
        FROM {orders}""",
    "condition_occurrence": """
        SELECT o_orderkey AS condition_occurrence_id, o_custkey AS person_id, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) + 3000000 AS condition_concept_id,
               CAST(o_orderdate AS DATE) AS condition_start_date, CAST(o_orderdate AS DATE) AS condition_end_date, o_orderstatus AS condition_status
        FROM {orders}""",
    "drug_exposure": """
        SELECT o_custkey AS person_id, l_partkey AS drug_concept_id, CAST(l_shipdate AS DATE) AS drug_exposure_start_date,
               CAST(l_shipdate AS DATE) + (CAST(l_quantity AS INT) - 1) AS drug_exposure_end_date, l_quantity AS quantity,
               CAST(l_quantity AS BIGINT) AS days_supply, l_returnflag AS route, l_orderkey AS visit_occurrence_id
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "procedure_occurrence": """
        SELECT l_orderkey * 8 + l_linenumber AS procedure_occurrence_id, o_custkey AS person_id, CAST(5000000 + l_linenumber AS BIGINT) AS procedure_concept_id,
               CAST(l_shipdate AS DATE) AS procedure_date, l_orderkey AS visit_occurrence_id, CAST(32800 + l_linenumber % 3 AS BIGINT) AS procedure_type_concept_id
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'""",
    "measurement": """
        SELECT o_orderkey AS measurement_id, o_custkey AS person_id, 4000000 + CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS measurement_concept_id,
               CAST(o_orderdate AS DATE) AS measurement_date, o_totalprice AS value_as_number, CAST(8700 + o_orderkey % 2 AS BIGINT) AS unit_concept_id,
               o_orderkey AS visit_occurrence_id
        FROM {orders}""",
    "observation": """
        SELECT o_orderkey AS observation_id, o_custkey AS person_id, 6000000 + o_orderkey % 7 AS observation_concept_id,
               CAST(o_orderdate AS DATE) AS observation_date, o_orderstatus AS value_as_string, o_orderkey AS visit_occurrence_id
        FROM {orders}""",
    "device_exposure": """
        SELECT l_orderkey * 8 + l_linenumber AS device_exposure_id, o_custkey AS person_id, CAST(7000000 + l_linenumber AS BIGINT) AS device_concept_id,
               CAST(l_shipdate AS DATE) AS device_exposure_start_date, CAST(l_shipdate AS DATE) + CAST(l_quantity AS INT) AS device_exposure_end_date,
               CAST(l_quantity AS BIGINT) AS quantity, l_orderkey AS visit_occurrence_id
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_linestatus = 'F'""",
    "death": """
        SELECT o_custkey AS person_id, MAX(CAST(o_orderdate AS DATE)) AS death_date, CAST(0 AS BIGINT) AS cause_concept_id FROM {orders} WHERE o_custkey % 20 = 0 GROUP BY o_custkey""",
    "concept": """
        SELECT p_partkey AS concept_id, p_name AS concept_name, 'Drug' AS domain_id, p_type AS concept_class_id, 'S' AS standard_concept, 'Part' AS vocabulary_id FROM {part}
        UNION ALL
        SELECT DISTINCT 1000000 + CAST(substr(p_brand, 7) AS BIGINT), p_brand, 'Drug', 'Ingredient', 'S', 'Brand' FROM {part}
        UNION ALL
        SELECT DISTINCT CAST(8000000 + ascii(substr(p_type, 1, 1)) * 256 + ascii(substr(p_type, 2, 1)) AS BIGINT), p_type, 'Drug', 'ATC 1st', 'C', 'ATC' FROM {part}
        UNION ALL
        SELECT DISTINCT CAST(substr(o_orderpriority, 1, 1) AS BIGINT) + 3000000, o_orderpriority, 'Condition', 'Disorder', 'S', 'Priority' FROM {orders}""",
    "concept_ancestor": """
        SELECT p_partkey AS ancestor_concept_id, p_partkey AS descendant_concept_id, 0 AS min_levels_of_separation FROM {part}
        UNION ALL
        SELECT DISTINCT 1000000 + CAST(substr(p_brand, 7) AS BIGINT), 1000000 + CAST(substr(p_brand, 7) AS BIGINT), 0 FROM {part}
        UNION ALL
        SELECT 1000000 + CAST(substr(p_brand, 7) AS BIGINT), p_partkey, 1 FROM {part}
        UNION ALL
        SELECT CAST(8000000 + ascii(substr(p_type, 1, 1)) * 256 + ascii(substr(p_type, 2, 1)) AS BIGINT), p_partkey, 2 FROM {part}
        UNION ALL
        SELECT DISTINCT CAST(substr(o_orderpriority, 1, 1) AS BIGINT) + 3000000, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) + 3000000, 0 FROM {orders}""",
    "drug_strength": """
        SELECT p_partkey AS drug_concept_id, 1000000 + CAST(substr(p_brand, 7) AS BIGINT) AS ingredient_concept_id,
               CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS DOUBLE) END AS amount_value,
               CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 8576 ELSE 9655 END END AS amount_unit_concept_id,
               CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_size AS DOUBLE) END AS numerator_value,
               CASE WHEN p_partkey % 3 <> 0 THEN 8576 END AS numerator_unit_concept_id,
               CASE WHEN p_partkey % 3 = 2 THEN CAST(36 AS DOUBLE) END AS denominator_value,
               CASE WHEN p_partkey % 3 = 1 THEN 8587 WHEN p_partkey % 3 = 2 THEN 8505 END AS denominator_unit_concept_id
        FROM {part}""",
    "location": """
        SELECT CAST(n_nationkey AS BIGINT) AS location_id, n_name AS state, r_name AS region FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
}
_BASE = ("customer", "orders", "lineitem", "part", "nation", "region")

@dataclass(frozen=True)
class Domain:
    """Columns of a clinical table by their role; None where the table has none."""

    table: str
    concept: str | None
    start: str
    end: str
    type: str | None = None
    source_concept: str | None = None


def _domain(table: str, name: str, start: str, end: str | None = None) -> Domain:
    return Domain(table, f"{name}_concept_id", start, end or start, f"{name}_type_concept_id", f"{name}_source_concept_id")


#: Domain -> where its records are.
DOMAINS = {
    "drug": _domain("drug_exposure", "drug", "drug_exposure_start_date", "drug_exposure_end_date"),
    "condition": _domain("condition_occurrence", "condition", "condition_start_date", "condition_end_date"),
    "visit": _domain("visit_occurrence", "visit", "visit_start_date", "visit_end_date"),
    "procedure": _domain("procedure_occurrence", "procedure", "procedure_date"),
    "measurement": _domain("measurement", "measurement", "measurement_date"),
    "observation": _domain("observation", "observation", "observation_date"),
    "device": _domain("device_exposure", "device", "device_exposure_start_date", "device_exposure_end_date"),
    "specimen": _domain("specimen", "specimen", "specimen_date"),
    "visit_detail": _domain("visit_detail", "visit_detail", "visit_detail_start_date", "visit_detail_end_date"),
    "death": Domain("death", "cause_concept_id", "death_date", "death_date", "death_type_concept_id", "cause_source_concept_id"),
    "observation_period": Domain("observation_period", None, "observation_period_start_date", "observation_period_end_date", "period_type_concept_id"),
    "condition_era": Domain("condition_era", "condition_concept_id", "condition_era_start_date", "condition_era_end_date"),
    "drug_era": Domain("drug_era", "drug_concept_id", "drug_era_start_date", "drug_era_end_date"),
    "dose_era": Domain("dose_era", "drug_concept_id", "dose_era_start_date", "dose_era_end_date"),
}


class OnUse(Mapping[str, DataFrame]):
    """Tables by name, each of which is planned when it is first asked for."""

    def __init__(self, make: Mapping[str, Callable[[], DataFrame]]):
        self._make, self._made = dict(make), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._make[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._make)

    def __len__(self) -> int:
        return len(self._make)

    def __or__(self, other: Mapping[str, DataFrame]) -> OnUse:
        return OnUse({n: (lambda n=n: self[n]) for n in self} | {n: (lambda n=n: other[n]) for n in other})

    def changed(self, change: Callable[[DataFrame], DataFrame]) -> OnUse:
        return OnUse({n: (lambda n=n: change(self[n])) for n in self})


@dataclass(frozen=True)
class Clinical:
    """Named tables. Tables are lazy; every change returns another container."""

    tables: Mapping[str, DataFrame]
    cohorts: dict[str, DataFrame] = field(default_factory=dict)
    name: str = "clinical"

    def __getitem__(self, name: str) -> DataFrame:
        return self.cohorts[name] if name in self.cohorts else self.tables[name]

    def __contains__(self, name: str) -> bool:
        return name in self.tables or name in self.cohorts

    def with_cohort(self, name: str, cohort: DataFrame) -> Clinical:
        return Clinical(self.tables, self.cohorts | {name: cohort}, self.name)

    def changed(self, change: Callable[[DataFrame], DataFrame]) -> Clinical:
        """The container with every table changed, as they are asked for."""
        return Clinical(OnUse({n: (lambda n=n: self.tables[n]) for n in self.tables}).changed(change), self.cohorts, self.name)

    def select_tables(self, names: Iterable[str]) -> Clinical:
        return Clinical({n: self.tables[n] for n in names}, self.cohorts, self.name)

    def events(self, domain: str) -> DataFrame:
        """(person_id, concept_id, start_date, end_date) of one domain: null ends become starts, ends before starts go."""
        d = DOMAINS[domain]
        e = self.tables[d.table].select("person_id", F.col(d.concept).cast("long").alias("concept_id"), F.col(d.start).alias("start_date"), F.coalesce(d.end, d.start).alias("end_date"))
        return e.where("start_date <= end_date")


def project(spark: SparkSession, sf_dir: str) -> Clinical:
    """Clinical tables over the driver's parquet tables."""
    base = OnUse({t: (lambda t=t: spark.read.parquet(f"{sf_dir}/{t}.parquet")) for t in _BASE})

    def planned(sql: str) -> DataFrame:
        used = {t: base[t] for t in _BASE if f"{{{t}}}" in sql}
        if "lineitem" in used and "orders" in used:
            used["lineitem"], used["orders"] = both_by_size(used["lineitem"], "l_orderkey", used["orders"], "o_orderkey")
        return spark.sql(sql, **used)

    return Clinical(OnUse({name: (lambda sql=sql: planned(sql)) for name, sql in PROJECTIONS.items()}))


def read_folder(spark: SparkSession, path: str, names: Iterable[str], file_format: str = "parquet") -> Clinical:
    """One file or folder per table; CSV with a header."""
    options = {"header": "true", "inferSchema": "true"} if file_format == "csv" else {}
    return Clinical({n: spark.read.format(file_format).options(**options).load(f"{path}/{n}.{file_format}") for n in names})


def read_catalog(spark: SparkSession, database: str) -> Clinical:
    return Clinical({t.name: spark.table(f"{database}.{t.name}") for t in spark.catalog.listTables(database)}, name=database)


def read_jdbc(spark: SparkSession, url: str, names: Iterable[str], key: str = "person_id", bounds: tuple[int, int] | None = None, partitions: int = 16, **options: str) -> Clinical:
    """Tables of a database, read in key ranges where bounds are given."""
    split = {"partitionColumn": key, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions)} if bounds else {}
    return Clinical({n: spark.read.format("jdbc").options(url=url, dbtable=n, **split, **options).load() for n in names})


def write_folder(clinical: Clinical, path: str, file_format: str = "parquet", mode: str = "errorifexists") -> None:
    options = {"header": "true"} if file_format == "csv" else {}
    for name, df in (clinical.tables | clinical.cohorts).items():
        df.write.mode(mode).format(file_format).options(**options).save(f"{path}/{name}.{file_format}")


def drop_table(spark: SparkSession, name: str) -> bool:
    """Whether there was a table to drop."""
    there = spark.catalog.tableExists(name)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    return there


def detect_database(spark: SparkSession) -> str:
    """The one database of the catalog that has a person table; none or several raise."""
    found = [d.name for d in spark.catalog.listDatabases() if spark.catalog.tableExists(f"{d.name}.person")]
    if len(found) != 1:
        raise ValueError(f"databases with a person table: {', '.join(found) or 'none'}")
    return found[0]


def validated(clinical: Clinical, version: str = "5.4", cohorts: Iterable[str] = ()) -> Clinical:
    """The container, if no table lacks a required column of the version; raises with all that are missing."""
    from eralith.sources.schema import CdmSchema

    schema = CdmSchema(version)
    missing = {n: schema.validate_columns("cohort" if n in cohorts else n, df.columns) for n, df in clinical.tables.items() if n in schema.tables or n in cohorts}
    if any(missing.values()):
        raise ValueError("; ".join(f"{n} lacks {', '.join(x)}" for n, x in missing.items() if x))
    return clinical


def with_eras(c: Clinical, gap: int = 30, ingredients: DataFrame | None = None) -> Clinical:
    """The container with drug_era and dose_era (by ingredient) and condition_era, made from the occurrences; doses where strengths are known.

    ingredients: ids (concept_id) that drug eras are made for, instead of the concepts of class Ingredient.
    """
    from eralith.functions.kernels import islands
    from eralith.operators.dose import dose_eras

    i = c["concept"].where("concept_class_id = 'Ingredient'") if ingredients is None else ingredients
    i = i.select(F.col("concept_id").alias("ancestor_concept_id"))
    to = c["concept_ancestor"].join(i, "ancestor_concept_id", "left_semi").select(F.col("ancestor_concept_id").alias("era_concept_id"), F.col("descendant_concept_id").alias("concept_id"))
    made = {}
    for name, e in (("drug", c.events("drug").join(to, "concept_id").drop("concept_id").withColumnRenamed("era_concept_id", "concept_id")), ("condition", c.events("condition"))):
        era = islands(e, ["person_id", "concept_id"], "start_date", "end_date", gap)
        era = era.select(F.xxhash64("person_id", "concept_id", "start_date").alias(f"{name}_era_id"), "person_id", F.col("concept_id").alias(f"{name}_concept_id"), F.col("start_date").alias(f"{name}_era_start_date"), F.col("end_date").alias(f"{name}_era_end_date"))
        made[f"{name}_era"] = era
    if "drug_strength" in c:
        made["dose_era"] = dose_eras(c, gap)
    return Clinical(dict(c.tables) | made if isinstance(c.tables, dict) else c.tables | made, c.cohorts, c.name)


def write_table(df: DataFrame, name: str, mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """A permanent table (or rows appended to one), read back."""
    df.write.mode(mode).partitionBy(*partition_by).saveAsTable(name)
    return df.sparkSession.table(name)
