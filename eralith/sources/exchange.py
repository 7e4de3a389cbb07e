"""Codelists, concept sets and results as files that other tools read."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eralith.operators import results as rs


def export_codelist(codelist: DataFrame, path: str, kind: str = "csv") -> None:
    """(name, concept_id) as CSV with a header, or as JSON lines, one codelist a line."""
    if kind == "csv":
        codelist.select("name", "concept_id").write.mode("overwrite").option("header", "true").csv(path)
    else:
        codelist.groupBy("name").agg(F.array_sort(F.collect_set("concept_id")).alias("concept_ids")).write.mode("overwrite").json(path)


def import_codelist(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    if kind == "csv":
        return spark.read.option("header", "true").schema("name string, concept_id long").csv(path)
    return spark.read.schema("name string, concept_ids array<long>").json(path).select("name", F.explode("concept_ids").alias("concept_id"))


def export_concept_set_expression(sets: Mapping[str, Sequence[Mapping]], folder: str) -> None:
    """One JSON file a concept set on the driver: items with concept, isExcluded, includeDescendants and includeMapped."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    for name, items in sets.items():
        rows = [{"concept": {"CONCEPT_ID": int(i["concept_id"])}, **{k: bool(i.get(s)) for k, s in _FLAGS.items()}} for i in items]
        Path(folder, f"{name}.json").write_text(json.dumps({"items": rows}, indent=2))


def import_concept_set_expression(folder: str) -> dict[str, list[dict]]:
    """Concept sets of a folder, or of one file, by their stems."""
    files = sorted(Path(folder).glob("*.json")) if Path(folder).is_dir() else [Path(folder)]
    out = {}
    for f in files:
        items = json.loads(f.read_text())["items"]
        out[f.stem] = [{"concept_id": int(i["concept"]["CONCEPT_ID"]), **{s: bool(i.get(k)) for k, s in _FLAGS.items()}} for i in items]
    return out


#: Flags of a concept set item.
_FLAGS = {"isExcluded": "is_excluded", "includeDescendants": "include_descendants", "includeMapped": "include_mapped"}


def export_summarised_result(result: DataFrame, settings: DataFrame, path: str) -> None:
    """Result and settings as one CSV: settings are rows with variable_name "settings", one for each of their columns."""
    columns = [x for x in settings.columns if x != "result_id"]
    rows = settings.select("result_id", F.explode(F.array(*(F.struct(F.lit(x).alias("estimate_name"), F.col(x).cast("string").alias("estimate_value")) for x in columns))).alias("e")).select("result_id", "e.*")
    fixed = {x: F.lit(None).cast("string") for x in rs.COLUMNS if x not in ("result_id", "estimate_name", "estimate_value")} | {"variable_name": F.lit("settings"), "estimate_type": F.lit("character")}
    rs.export(result.unionByName(rows.withColumns(fixed).select(*rs.COLUMNS)), path)


def import_summarised_result(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(result, settings) of an export; the settings' columns are their few distinct names."""
    every = rs.read_export(spark, path)
    of = every.where("variable_name = 'settings'")
    names = [r[0] for r in of.select("estimate_name").distinct().orderBy("estimate_name").toLocalIterator()]
    settings = of.groupBy("result_id").pivot("estimate_name", names).agg(F.first("estimate_value")) if names else of.select("result_id").distinct()
    return every.where("variable_name is null or variable_name != 'settings'"), settings
