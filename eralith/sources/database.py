"""Tables of a database through JDBC: reads by key ranges that the database itself tells, and writes that may be repeated.

A read asks the database for the least and greatest key and splits the range between, so the number of connections and the
size of each part are settled without the caller's knowing the data; filters and columns go down to the database. A write goes to
a staging table in parallel, part by part, and becomes the table in one transaction at the end: a job that fails half-way leaves
the table as it was, and a batch that is written again replaces its own rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eralith.sources.clinical import Clinical
from eralith.sources.layout import BATCH

_KEYS = ("person_id", "subject_id")
#: Number of a row within its batch, in staging tables alone.
_ROW = "batch_row"


@dataclass(frozen=True)
class Database:
    """A database that the driver and all executors reach. options: user, password, driver, fetchsize and the like."""

    spark: SparkSession
    url: str
    options: Mapping[str, str] = field(default_factory=dict)

    def _reader(self, **more: str) -> Any:
        return self.spark.read.format("jdbc").options(url=self.url, **{**self.options, **more})

    def quoted(self, name: str) -> str:
        """A name as it stands, in the database's own quotes."""
        return self.spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(self.url).quoteIdentifier(name)

    def ask(self, sql: str) -> list:
        """The few rows of a query that the database answers itself."""
        return self._reader(query=sql).load().collect()

    @contextmanager
    def _connection(self) -> Iterator[Any]:
        """A transaction from the driver, over Spark's own connection to the database."""
        jvm = self.spark._jvm
        if driver := self.options.get("driver"):
            jvm.java.lang.Class.forName(driver, True, jvm.java.lang.Thread.currentThread().getContextClassLoader())
        properties = jvm.java.util.Properties()
        for k in ("user", "password"):
            if k in self.options:
                properties.setProperty(k, self.options[k])
        c = jvm.java.sql.DriverManager.getConnection(self.url, properties)
        c.setAutoCommit(False)
        try:
            yield c
            c.commit()
        except BaseException:
            c.rollback()
            raise
        finally:
            c.close()

    def execute(self, *statements: str) -> None:
        """Statements as one transaction: all or none."""
        with self._connection() as c:
            for s in statements:
                statement = c.createStatement()
                statement.execute(s)
                statement.close()

    def tables(self) -> list[str]:
        """Names of the tables, in lower case."""
        with self._connection() as c:
            found, names = c.getMetaData().getTables(None, None, "%", None), []
            while found.next():
                if found.getString("TABLE_TYPE") == "TABLE":
                    names.append(found.getString("TABLE_NAME").lower())
        return sorted(names)

    def bounds(self, table: str, key: str) -> tuple[int, int] | None:
        """The least and greatest key, a column's name as it stands; None where there is none."""
        k = self.quoted(key)
        lo, hi = self.ask(f"SELECT MIN({k}) AS lo, MAX({k}) AS hi FROM {table}")[0]
        return None if lo is None else (int(lo), int(hi))

    def read(self, table: str, key: str | None = None, partitions: int = 16) -> DataFrame:
        """A table in parts of its key's range, names in lower case; key: the person column if not named. Rows without a key come with the first part.

        Without a person column, or without any key, it is read in one part.
        """
        names = {n.lower(): n for n in self._reader(dbtable=table).load().columns}
        key = names[key.lower()] if key else next((names[k] for k in _KEYS if k in names), None)
        split = {}
        if key and (span := self.bounds(table, key)):
            split = {"partitionColumn": key, "lowerBound": str(span[0]), "upperBound": str(span[1] + 1), "numPartitions": str(max(1, min(partitions, span[1] - span[0] + 1)))}
        df = self._reader(dbtable=table, **split).load()
        return df.toDF(*(n.lower() for n in df.columns))

    def clinical(self, names: Iterable[str] | None = None, partitions: int = 16) -> Clinical:
        """A container over the database's tables."""
        return Clinical({n: self.read(n, partitions=partitions) for n in (names or self.tables())}, name=self.url.split(";")[0])

    def write(self, df: DataFrame, table: str, batch: str, partitions: int = 16) -> None:
        """df's rows as one batch of a table, which is made where there is none: written once however often this is called.

        batch_name is a column of the table. Executors fill a staging table, which a failed job leaves behind and the next
        call for this batch replaces; one transaction then takes the batch's earlier rows out and the new ones in. Rows that a
        task has written twice, as it was repeated after its executor was lost, are told by their numbers: nothing is taken
        in then, and the call is to be made again.
        """
        columns = [c.lower() for c in df.columns]
        if {BATCH, _ROW} & set(columns) or len(set(columns)) < len(columns):
            raise ValueError(f"{BATCH} and {_ROW} are the table's own columns, and names must differ in more than case")
        staging = f"{table}_{uuid.uuid5(uuid.NAMESPACE_OID, batch).hex[:12]}"
        rows = df.toDF(*columns).coalesce(partitions).withColumn(_ROW, F.monotonically_increasing_id())
        options = {"url": self.url, **self.options}
        rows.write.format("jdbc").options(**options, dbtable=staging).mode("overwrite").save()
        row, name, value = self.quoted(_ROW), self.quoted(BATCH), "'" + batch.replace("'", "''") + "'"
        n, different = self.ask(f"SELECT COUNT(*) AS n, COUNT(DISTINCT {row}) AS d FROM {staging}")[0]
        if n != different:
            raise RuntimeError(f"{n - different} rows of {staging} were written twice: write the batch again")
        if table.lower() not in self.tables():
            empty = df.toDF(*columns).limit(0).withColumn(BATCH, F.lit(""))
            empty.write.format("jdbc").options(**options, dbtable=table, createTableColumnTypes=f"{BATCH} VARCHAR(200)").mode("append").save()
        names = ", ".join(map(self.quoted, columns))
        self.execute(f"DELETE FROM {table} WHERE {name} = {value}", f"INSERT INTO {table} ({names}, {name}) SELECT {names}, {value} FROM {staging}")
        self.execute(f"DROP TABLE {staging}")

    def drop(self, table: str) -> bool:
        """Whether there was a table to drop."""
        there = table.lower() in self.tables()
        if there:
            self.execute(f"DROP TABLE {table}")
        return there
