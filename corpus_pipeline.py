"""A corpus-cleaning pipeline of five stages over documents.

Each stage works on all rows that its predecessor kept; all but the last return the columns of their input. A row
without an id leaves at the first stage, like a text that the quality rules reject. Where an id stands at several texts,
each row is judged by its own text; the near-duplicate stage takes them for one document and keeps or drops them together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eralith.llm._spark import delete_tables, recorded, text_hash, written
from eralith.llm.ngram_join import jaccard_components
from eralith.llm.packing import best_fit_packing
from eralith.llm.quality_rules import quality_rules
from eralith.llm.secret_scan import secret_scan
from eralith.llm.substring_dedup import substring_dedup


def _beside(docs: DataFrame, found: DataFrame, key: Column, how: str) -> tuple[DataFrame, Callable[[str], Column]]:
    """docs joined with found (doc_id, key, columns...) by id and key, and how found's columns are got at.

    These get names longer than any that docs has, so that no column of docs can be taken for one.
    """
    longest = "_" * (1 + max(map(len, docs.columns)))
    v = found.select(*(F.col(c).alias(longest + c) for c in found.columns))
    both = docs.join(v, (docs["doc_id"] == v[longest + "doc_id"]) & (key == v[longest + found.columns[1]]), how)
    return both, lambda name: both[longest + name]


def _refilled(docs: DataFrame, both: DataFrame, text: Column) -> DataFrame:
    """The columns of docs with another text, and n_chars counted anew where there is one."""
    new = {"text": text, "n_chars": F.length(text).cast(dict(docs.dtypes).get("n_chars", "bigint"))}
    return both.select(*(new[c].alias(c) if c in new else docs[c] for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep (7)."""
    good = quality_rules(docs).where("kept").select("doc_id", "text_hash").distinct()
    return _beside(docs, good, text_hash(docs["text"]), "left_semi")[0]


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least id, of each group linked by 5-word shingles at a similarity of 0.8 (4).

    Of rows with equal id and text one stays, the least by the other columns.
    """
    groups = jaccard_components(docs, k=5, percent=80)
    others = groups.where("component_id != doc_id").select("doc_id").distinct()
    kept = docs.where("doc_id is not null").join(others, "doc_id", "left_anti").select(docs.columns)
    # texts are shuffled for that only where rows do repeat
    if docs.groupBy("doc_id", text_hash(docs["text"])).count().where("count > 1").isEmpty():
        return kept
    nth, rest = "_" * (1 + max(map(len, docs.columns))), [c for c in docs.columns if c not in ("doc_id", "text")]
    return kept.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", "text").orderBy(*(rest or ["doc_id"])))).where(F.col(nth) == 1).drop(nth)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without windows of 50 words that a smaller id has as well (1), otherwise as they were.

    A text of which no word is left goes.
    """
    cut = substring_dedup(docs).where("n_removed > 0").select("doc_id", "text_hash", F.when(F.col("kept_text") != "", F.col("cut_text")).otherwise("").alias("cut"))
    both, found = _beside(docs, cut.dropDuplicates(["doc_id", "text_hash"]), text_hash(docs["text"]), "left")
    cut = found("cut")
    return _refilled(docs, both.where(cut.isNull() | (cut != "")), F.coalesce(cut, docs["text"]))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret span replaced by <secret> (8)."""
    scan, _ = secret_scan(docs)
    v = scan.where(F.size("spans") > 0).select("doc_id", "blob", "spans").dropDuplicates(["doc_id", "blob"])
    both, found = _beside(docs, v, F.unhex(F.sha2(docs["text"], 256)), "left")
    spans = found("spans")
    # spans may overlap: each piece of text runs from the furthest end so far to the next start
    walked = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(docs["text"], acc["at"] + 1, s["start"] - acc["at"]), F.lit("<secret>")).alias("out")),
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(docs["text"], acc["at"] + 1, F.length(docs["text"]))),
    )
    return _refilled(docs, both, F.when(spans.isNull(), docs["text"]).otherwise(walked))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2,048 tokens and what goes into each (9)."""
    return best_fit_packing(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("secret scans", secrets),
    ("best-fit packing", packing),
]
#: The stages' verdicts (sketches, suffix runs, packing) are not SQL: tests/llm holds run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each written and read again as the next one's input.

    Tables that a stage has written on its way are deleted once its result is, and so is its input; other tables, of
    operators or pipelines that run beside it, are not touched.
    """
    docs, earlier = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        with recorded() as tables:
            docs = written(stage(spark, docs, sf_dir))
        delete_tables(spark, earlier + tables[:-1])
        earlier = tables[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
