"""Spark helpers of the operators: shared folder, written tables, id filters, runs of equal keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bound of an id filter's size in bits: 16 MiB is all that is ever broadcast for one.
MOST_BITS = 1 << 27


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only where it is unset on a single machine, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="eralith-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/eralith/{spark.sparkContext.applicationId}"


def clear_written(spark: SparkSession) -> None:
    """Deletes all tables that this application has written, once its results are stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Folders of the tables that the block of recorded() in force has written; each thread has its own.
_recorded: ContextVar[list[str] | None] = ContextVar("recorded", default=None)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders, in order, of the tables that operators write within the block: what others write is never among them.

    Blocks may be nested; a table belongs to the innermost.
    """
    folders: list[str] = []
    token = _recorded.set(folders)
    try:
        yield folders
    finally:
        _recorded.reset(token)


def delete_tables(spark: SparkSession, folders: Iterable[str]) -> None:
    """Deletes written tables, which nothing may read any more."""
    for path in map(spark._jvm.org.apache.hadoop.fs.Path, folders):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """The same rows, read from a table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if (folders := _recorded.get()) is not None:
        folders.append(path)
    return spark.read.schema(df.schema).parquet(path)


def text_hash(text: Column) -> Column:
    """What tells texts of one id apart in an operator's result."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def documents(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(doc, text, sig, more...) without rows that have no id. sig tells texts of one id apart."""
    d = docs.select(
        F.col(id_col).cast("long").alias("doc"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        *(F.col(c).alias(f"m{i}") for i, c in enumerate(more)),
    ).where("doc is not null")
    return d.withColumn("sig", F.xxhash64("text"))


def id_filter(ids: DataFrame, key: str) -> Callable[[Column], Column]:
    """A test that every key of ids passes and few others do: 16 bits a key, at most MOST_BITS in all.

    It only saves shuffling; a join follows wherever the answer has to be exact. The bits are gathered by a
    partial aggregate of at most MOST_BITS / 64 rows.
    """
    n = ids.count()
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(10, (16 * max(n, 1)).bit_length()))
    at = F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(bits))
    words = (
        ids.select(at.alias("b"))
        .groupBy(F.shiftright("b", 6).cast("int").alias("w"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(b % 64 as int)))").alias("m"))
        .toArrow()
    )
    table = np.zeros(bits >> 6, np.int64)
    table[words["w"].to_numpy()] = words["m"].to_numpy()
    shared = ids.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def held(b: pd.Series) -> pd.Series:
        v = b.to_numpy(np.int64)
        return pd.Series((shared.value[v >> 6] >> (v & 63)) & 1 == 1)

    return lambda c: held(F.pmod(F.xxhash64(c, F.lit(7)), F.lit(bits)))


def shared_runs(
    df: DataFrame, keys: list[str], columns: list[str], schema: str, between_texts: bool, aggregate: bool = False
) -> DataFrame:
    """Rows of (keys..., sig, doc, columns...) whose keys also stand elsewhere.

    Of equal texts (sig) the one with the least doc speaks for all; so a key counts as shared if two different
    texts have it (between_texts), or if it stands at two places of those least documents (a row may stand for n places,
    if n is among the columns). One sort for each
    partition; a task reads its rows as a stream and holds no more than the rows of one text for one key, so a
    key that stands in a third of all rows needs no more memory than others. aggregate: (doc, sig, n) counts. Where df has
    a column known, rows with it count as shared whatever else their key holds.
    """
    order = [*keys, "sig", "doc"]
    flag = ["known"] if "known" in df.columns else []
    d = df.select(*order, *columns, *flag).repartition(*keys).sortWithinPartitions(*order)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # keys of the open run
        sub: tuple = (0, 0)  # its open text: sig, least doc
        shared, rows, held = False, 0, []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.table(batch)
            ks = [np.asarray(table[k]) for k in keys]
            sig, doc = np.asarray(table["sig"]), np.asarray(table["doc"])
            n = len(doc)
            new = np.ones(n, bool)
            new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in ks])
            goes_on = last is not None and all(k[0] == v for k, v in zip(ks, last, strict=True))
            new_sub = new.copy()
            new_sub[1:] |= sig[1:] != sig[:-1]
            if goes_on:
                new[0] = False
                new_sub[0] = sig[0] != sub[0]
            at = np.flatnonzero(new_sub)
            least = np.full(n, sub[1], doc.dtype)
            least[at[0] if len(at) else n :] = np.repeat(doc[at], np.diff(np.append(at, n)))
            speaks = doc == least
            run = np.cumsum(new)  # 0: the run that goes on
            n_runs = int(run[-1]) + 1
            weight = new_sub if between_texts else speaks * np.asarray(table["n"]) if "n" in columns else speaks
            amount = np.bincount(run, weights=weight, minlength=n_runs)
            if goes_on:
                amount[0] += rows
            is_shared = amount >= 2
            if flag:
                is_shared |= np.bincount(run, weights=np.asarray(table["known"].to_numpy(zero_copy_only=False)), minlength=n_runs) > 0
            is_shared[0] |= shared and goes_on
            keep = is_shared[run] & speaks
            out = []
            if goes_on and held and is_shared[0]:
                out += held
                held = []
            if not goes_on or n_runs > 1:
                held = []
            out.append(table.filter(pa.array(keep)))
            if not is_shared[-1]:
                tail = (run == n_runs - 1) & speaks
                held.append(table.filter(pa.array(tail)))
            last, sub = tuple(k[-1] for k in ks), (sig[-1], least[-1])
            shared, rows = bool(is_shared[-1]), amount[-1]
            found = pa.concat_tables(out)
            if not found.num_rows:
                continue
            if aggregate:
                found = found.group_by(["doc", "sig"]).aggregate([("sig", "count")])
                found = pa.table({"doc": found["doc"], "sig": found["sig"], "n": found["sig_count"]})
                yield from found.to_batches()
            else:
                yield from found.select(["doc", "sig", *columns]).combine_chunks().to_batches()

    return d.mapInArrow(work, schema)
