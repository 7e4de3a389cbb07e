"""Permanent tables laid out by person, and temporary results.

A table of this layout is bucketed by its person column and sorted within buckets. Tables of one number of buckets meet on the
person, and are grouped or windowed by person, without an exchange: the shuffle is paid once, when a table is written. Rows
come in named batches, each a partition of its own; writing a batch again replaces it, so a job that is repeated after a
failure adds its rows once.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eralith.sources.clinical import Clinical

#: Partition column that names the batch of a row.
BATCH = "batch_name"
_PERSONS = ("person_id", "subject_id")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which driver and executors share; on a single machine one of our own where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="eralith-")
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/eralith/{spark.sparkContext.applicationId}"


def temporary(df: DataFrame) -> DataFrame:
    """A temporary result: the rows of df, written once under the shared folder and read from there."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def person_column(columns: Iterable[str]) -> str:
    found = [c for c in _PERSONS if c in set(columns)]
    if len(found) != 1:
        raise ValueError(f"there must be one of {', '.join(_PERSONS)} among the columns")
    return found[0]


def _order(df: DataFrame, key: str) -> list[str]:
    """The person, then the first date column if there is one: the order of most windows over records."""
    return [key, *[c for c, t in df.dtypes if t == "date"][:1]]


def _dealt(df: DataFrame, buckets: int, key: str) -> DataFrame:
    # a task for each bucket, so that a batch has one file a bucket and not one for each task and bucket
    return df.repartition(buckets, key)


def lay_out(df: DataFrame, name: str, buckets: int | None = None, batch: str = "first", path: str | None = None, most_rows_per_file: int = 50_000_000) -> DataFrame:
    """A permanent table of df's rows by person, read back; a table of that name is replaced.

    path: a folder for an external table, else the warehouse. buckets: as many for all tables that should meet, so many that one
    bucket's rows of the largest table suit a task; None takes spark.sql.shuffle.partitions. Rows without a person are kept, in one bucket. batch_name is
    the table's last column.
    """
    if BATCH in df.columns:
        raise ValueError(f"{BATCH} is the layout's own column")
    key = person_column(df.columns)
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    writer = _dealt(df.withColumn(BATCH, F.lit(batch)), buckets, key).write.mode("overwrite").format("parquet")
    writer = writer.partitionBy(BATCH).bucketBy(buckets, key).sortBy(*_order(df, key)).option("maxRecordsPerFile", most_rows_per_file)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def layout_of(spark: SparkSession, name: str) -> tuple[str, int]:
    """(person column, buckets) of a table that lay_out has written."""
    told = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
    if "Num Buckets" not in told:
        raise ValueError(f"{name} is not laid out by person")
    return told["Bucket Columns"].strip("[]`"), int(told["Num Buckets"])


def append_batch(df: DataFrame, name: str, batch: str) -> DataFrame:
    """The table with a batch of rows added, or replaced where there is one of that name; other batches are not touched.

    Columns go by name; df may lack none of them. Appending the same batch twice leaves its rows once.
    """
    spark = df.sparkSession
    columns = [c for c in spark.table(name).columns if c != BATCH]
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{name} also has the columns {', '.join(missing)}")
    key, buckets = layout_of(spark, name)
    quoted = batch.replace("\\", "\\\\").replace("'", "\\'")
    rows = _dealt(df.select(*columns), buckets, key)
    spark.sql(f"INSERT OVERWRITE TABLE {name} PARTITION ({BATCH} = '{quoted}') SELECT {', '.join(f'`{c}`' for c in columns)} FROM {{rows}}", rows=rows)
    spark.catalog.refreshTable(name)
    return spark.table(name)


def batches(spark: SparkSession, name: str) -> list[str]:
    """The names of a table's batches, from the catalog."""
    return sorted(r[0].split("=", 1)[1] for r in spark.sql(f"SHOW PARTITIONS {name}").collect())


def lay_out_clinical(c: Clinical, prefix: str, buckets: int | None = None, path: str | None = None, names: Iterable[str] | None = None) -> Clinical:
    """The container with its tables by person, and its cohorts, as permanent tables prefix + name; tables without a person stay as they are."""
    chosen = set(names) if names is not None else {*c.tables, *c.cohorts}

    def kept(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        return {n: lay_out(t, prefix + n, buckets, path=f"{path}/{prefix}{n}" if path else None).drop(BATCH) if n in chosen and set(_PERSONS) & set(t.columns) else t for n, t in tables.items()}

    return Clinical(kept(c.tables), kept(c.cohorts), c.name)
