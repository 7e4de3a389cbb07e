"""Catalogue of the clinical schema: tables, their fields by role, and what a version requires.

Event tables follow one pattern, so their fields come from the domain registry by rule; only what departs from it is listed.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from enum import StrEnum

from pyspark.sql import types as T

from eralith.sources.clinical import DOMAINS


class CdmVersion(StrEnum):
    V53 = "5.3"
    V54 = "5.4"


class TableSchema(StrEnum):
    """Kind of a table."""

    CDM = "cdm_table"
    COHORT = "cohort"


class TableGroup(StrEnum):
    VOCAB = "vocab"
    CLINICAL = "clinical"
    DERIVED = "derived"
    ALL = "all"
    DEFAULT = "default"


class CdmDataType(StrEnum):
    INTEGER = "integer"
    FLOAT = "float"
    VARCHAR = "varchar"
    DATE = "date"
    DATETIME = "datetime"
    LOGICAL = "logical"


_SPARK = {CdmDataType.INTEGER: T.LongType(), CdmDataType.FLOAT: T.DoubleType(), CdmDataType.VARCHAR: T.StringType(), CdmDataType.DATE: T.DateType(), CdmDataType.DATETIME: T.TimestampType(), CdmDataType.LOGICAL: T.BooleanType()}


@dataclass(frozen=True)
class FieldSpec:
    table: str
    name: str
    type: CdmDataType
    required: bool = False

    @property
    def spark(self) -> T.StructField:
        return T.StructField(self.name, _SPARK[self.type], not self.required)


@dataclass(frozen=True)
class TableSpec:
    """A table: its fields, its groups and the columns of its roles (None where it has none)."""

    name: str
    fields: tuple[FieldSpec, ...]
    groups: tuple[TableGroup, ...]
    id_column: str | None = None
    start: str | None = None
    end: str | None = None
    concept: str | None = None
    source_concept: str | None = None
    type_concept: str | None = None

    @property
    def spark(self) -> T.StructType:
        return T.StructType([f.spark for f in self.fields])


@dataclass(frozen=True)
class ResultFieldSpec:
    """A column of a summarised result; a pair names the column that it goes with."""

    name: str
    type: CdmDataType
    pair: str | None = None


#: Fields that departs from the pattern of event tables, "!" where required, with their types.
_OTHER = {
    "person": "person_id! integer, gender_concept_id! integer, year_of_birth! integer, month_of_birth integer, day_of_birth integer, race_concept_id! integer, ethnicity_concept_id! integer, location_id integer",
    "observation_period": "observation_period_id! integer, person_id! integer, observation_period_start_date! date, observation_period_end_date! date, period_type_concept_id! integer",
    "death": "person_id! integer, death_date! date, death_type_concept_id integer, cause_concept_id integer, cause_source_concept_id integer",
    "condition_era": "condition_era_id! integer, person_id! integer, condition_concept_id! integer, condition_era_start_date! date, condition_era_end_date! date, condition_occurrence_count integer",
    "drug_era": "drug_era_id! integer, person_id! integer, drug_concept_id! integer, drug_era_start_date! date, drug_era_end_date! date, drug_exposure_count integer, gap_days integer",
    "dose_era": "dose_era_id! integer, person_id! integer, drug_concept_id! integer, unit_concept_id! integer, dose_value! float, dose_era_start_date! date, dose_era_end_date! date",
    "location": "location_id! integer, state varchar",
    "concept": "concept_id! integer, concept_name! varchar, domain_id! varchar, vocabulary_id! varchar, concept_class_id! varchar, standard_concept varchar, concept_code! varchar",
    "concept_ancestor": "ancestor_concept_id! integer, descendant_concept_id! integer, min_levels_of_separation! integer, max_levels_of_separation! integer",
    "concept_relationship": "concept_id_1! integer, concept_id_2! integer, relationship_id! varchar",
    "drug_strength": "drug_concept_id! integer, ingredient_concept_id! integer, amount_value float, amount_unit_concept_id integer, numerator_value float, numerator_unit_concept_id integer, denominator_value float, denominator_unit_concept_id integer",
    "cohort": "cohort_definition_id! integer, subject_id! integer, cohort_start_date! date, cohort_end_date! date",
}
#: Fields that single event tables have beside the pattern's.
_MORE = {
    "drug": "quantity float, days_supply integer, refills integer, stop_reason varchar, sig varchar, route_concept_id integer",
    "measurement": "value_as_number float, value_as_concept_id integer, unit_concept_id integer, range_low float, range_high float",
    "observation": "value_as_number float, value_as_string varchar, value_as_concept_id integer, unit_concept_id integer",
    "device": "quantity integer",
}
_VOCAB, _DERIVED = ("concept", "concept_ancestor", "concept_relationship", "drug_strength"), ("condition_era", "drug_era", "dose_era")
_ERAS_AND_SPANS = {"observation_period", "death", "condition_era", "drug_era", "dose_era"}


def _fields(table: str, text: str) -> tuple[FieldSpec, ...]:
    pairs = (x.split() for x in text.split(", "))
    return tuple(FieldSpec(table, n.rstrip("!"), CdmDataType(t), n.endswith("!")) for n, t in pairs)


def _event(domain: str) -> str:
    d = DOMAINS[domain]
    dates = f"{d.start}! date" + (f", {d.end} date" if d.end != d.start else "")
    own = f"{d.table}_id! integer, person_id! integer, {d.concept}! integer, {dates}, {d.type}! integer, provider_id integer, {d.source_concept} integer"
    own += "" if d.table == "visit_occurrence" else ", visit_occurrence_id integer"
    return own + (f", {_MORE[domain]}" if domain in _MORE else "")


class CdmSchema:
    """The tables of one version. Version 5.3 has the same tables and fields as far as this catalogue goes."""

    def __init__(self, version: str | CdmVersion = CdmVersion.V54):
        self.version = CdmVersion(version)
        text = _OTHER | {d.table: _event(k) for k, d in DOMAINS.items() if d.table not in _ERAS_AND_SPANS}
        by_table = {d.table: d for d in DOMAINS.values()}
        self.tables: dict[str, TableSpec] = {}
        for name, fields in text.items():
            d, specs = by_table.get(name), _fields(name, fields)
            group = TableGroup.VOCAB if name in _VOCAB else TableGroup.DERIVED if name in _DERIVED else TableGroup.CLINICAL
            groups = (group, TableGroup.ALL, *((TableGroup.DEFAULT,) if group is not TableGroup.DERIVED else ()))
            first = specs[0].name
            have = {f.name for f in specs}
            of = (lambda x: x if x in have else None)
            self.tables[name] = TableSpec(name, specs, groups, first, *((d.start, d.end, of(d.concept), of(d.source_concept), of(d.type)) if d else ()))

    def table_names_in_group(self, group: str | TableGroup) -> list[str]:
        return [n for n, t in self.tables.items() if TableGroup(group) in t.groups]

    def fields_for_table(self, table: str) -> tuple[FieldSpec, ...]:
        return self.tables[table].fields

    def required_fields_for_table(self, table: str) -> list[str]:
        return [f.name for f in self.tables[table].fields if f.required]

    def validate_columns(self, table: str, columns: Iterable[str]) -> list[str]:
        """Required columns that are missing; an unknown table raises."""
        if table not in self.tables:
            raise ValueError(f"no such table in version {self.version}: {table}")
        have = {c.lower() for c in columns}
        return [f for f in self.required_fields_for_table(table) if f not in have]


def start_date_column(table: str) -> str:
    return _role(table, "start")


def end_date_column(table: str) -> str:
    return _role(table, "end")


def standard_concept_id_column(table: str) -> str:
    return _role(table, "concept")


def source_concept_id_column(table: str) -> str:
    return _role(table, "source_concept")


def _role(table: str, role: str) -> str:
    d = next((d for d in DOMAINS.values() if d.table == table), None)
    if table == "cohort" and role in ("start", "end"):
        return f"cohort_{role}_date"
    column = getattr(d, role, None) if d else None
    if column is None:
        raise ValueError(f"{table} has no {role.replace('_', ' ')} column")
    return column


def person_id_column(columns: Iterable[str]) -> str:
    """person_id or subject_id, whichever a table has."""
    columns = set(columns)
    for name in ("person_id", "subject_id"):
        if name in columns:
            return name
    raise ValueError("neither person_id nor subject_id")


def tbl_group(group: str | Iterable[str], version: str | CdmVersion = CdmVersion.V54) -> list[str]:
    """Names of the tables in one or several groups, each once."""
    groups = [group] if isinstance(group, str) else list(group)
    return list(dict.fromkeys(n for g in groups for n in CdmSchema(version).table_names_in_group(g)))


#: The columns of a summarised result.
RESULT_FIELDS = tuple(
    ResultFieldSpec(n, CdmDataType.INTEGER if n == "result_id" else CdmDataType.VARCHAR, n.replace("_name", "_level") if n.endswith("_name") and n != "cdm_name" and not n.startswith("estimate") else None)
    for n in (
        "result_id", "cdm_name", "group_name", "group_level", "strata_name", "strata_level", "variable_name", "variable_level",
        "estimate_name", "estimate_type", "estimate_value", "additional_name", "additional_level",
    )
)
