"""Small hand-written patients for trials: read from JSON, CSV or workbooks, validated, typed, and made into clinical tables."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from eralith.sources.clinical import Clinical
from eralith.sources.schema import CdmSchema


def read_patients(path: str) -> dict[str, list[dict]]:
    """Table -> rows, from one JSON file of tables, or from a folder of CSV files (or a workbook) with one table each."""
    p = Path(path)
    if p.is_dir():
        import csv

        out = {}
        for f in sorted(p.glob("*.csv")):
            with f.open(newline="") as lines:
                out[f.stem] = [{k: v if v != "" else None for k, v in r.items()} for r in csv.DictReader(lines)]
        return out
    if p.suffix == ".json":
        return json.loads(p.read_text())
    import pandas as pd

    return {name: sheet.astype(object).where(sheet.notna(), None).to_dict("records") for name, sheet in pd.read_excel(p, sheet_name=None).items()}


def validate_patient_data(tables: Mapping[str, Sequence[Mapping]], version: str = "5.4") -> list[str]:
    """What is wrong: unknown tables and fields, missing required fields, persons that no row of person has."""
    schema, wrong = CdmSchema(version), []
    persons = {int(r["person_id"]) for r in tables.get("person", ()) if r.get("person_id") is not None}
    for name, rows in tables.items():
        if name not in schema.tables:
            wrong.append(f"{name}: no such table")
            continue
        known, needed = {f.name for f in schema.fields_for_table(name)}, schema.required_fields_for_table(name)
        for k, row in enumerate(rows):
            wrong += [f"{name} {k}: no such field {c}" for c in row if c not in known]
            wrong += [f"{name} {k}: no {c}" for c in needed if row.get(c) is None]
            if "person_id" in row and row["person_id"] is not None and int(row["person_id"]) not in persons:
                wrong.append(f"{name} {k}: person {row['person_id']} is not in person")
    return wrong


def patients_cdm(spark: SparkSession, tables: str | Mapping[str, Sequence[Mapping]], version: str = "5.4", name: str = "patients") -> Clinical:
    """Clinical tables of hand-written rows (or of a path to them), with every column of the version; errors in them raise."""
    rows = read_patients(tables) if isinstance(tables, str) else tables
    wrong = validate_patient_data(rows, version)
    if wrong:
        raise ValueError("; ".join(wrong))
    out = {}
    for t, spec in CdmSchema(version).tables.items():
        texts = [tuple(None if r.get(f.name) is None else str(r[f.name]) for f in spec.fields) for r in rows.get(t, ())]
        df = spark.createDataFrame(texts, ", ".join(f"{f.name} string" for f in spec.fields))
        out[t] = df.select(*(F.col(f.name).cast(f.spark.dataType).alias(f.name) for f in spec.fields))
    return Clinical(out, name=name)


def generate_test_tables(persons: int = 3, events: int = 2, version: str = "5.4") -> dict[str, list[dict]]:
    """A filled-in start for hand-written patients: persons, one observation period each, and events of four domains."""
    schema = CdmSchema(version)
    out: dict[str, list[dict]] = {"person": [], "observation_period": []}
    for p in range(1, persons + 1):
        out["person"].append({"person_id": p, "gender_concept_id": (8507, 8532)[p % 2], "year_of_birth": 1940 + 7 * p % 60, "race_concept_id": 0, "ethnicity_concept_id": 0})
        out["observation_period"].append({"observation_period_id": p, "person_id": p, "observation_period_start_date": "2010-01-01", "observation_period_end_date": "2019-12-31", "period_type_concept_id": 0})
    for table in ("condition_occurrence", "drug_exposure", "measurement", "procedure_occurrence"):
        spec = schema.tables[table]
        out[table] = []
        for n in range(persons * events):
            date = f"{2011 + n % 8}-0{1 + n % 9}-15"
            values = {spec.id_column: n + 1, "person_id": 1 + n % persons, spec.concept: 1 + n % 5, spec.start: date, spec.end: date, spec.type_concept: 0}
            out[table].append(values)
    return out
