"""Typed tree of a cohort definition, read from its JSON form; a key that no part knows raises."""

from __future__ import annotations

import json
import types
from collections.abc import Mapping
from dataclasses import MISSING, dataclass, fields
from pathlib import Path
from typing import Any, Union, get_args, get_origin, get_type_hints

#: Kind of criterion -> domain of the clinical tables.
DOMAIN_OF = {
    "ConditionOccurrence": "condition", "DrugExposure": "drug", "ProcedureOccurrence": "procedure", "VisitOccurrence": "visit", "Observation": "observation",
    "Measurement": "measurement", "DeviceExposure": "device", "Death": "death", "VisitDetail": "visit_detail", "ObservationPeriod": "observation_period",
    "ConditionEra": "condition_era", "DrugEra": "drug_era", "Specimen": "specimen", "DoseEra": "dose_era",
}


@dataclass(frozen=True)
class Concept:
    concept_id: int
    concept_name: str = ""
    domain_id: str = ""
    vocabulary_id: str = ""
    concept_class_id: str = ""
    standard_concept: str | None = None
    concept_code: str = ""


@dataclass(frozen=True)
class ConceptItem:
    concept: Concept
    is_excluded: bool = False
    include_descendants: bool = False
    include_mapped: bool = False


@dataclass(frozen=True)
class ConceptSet:
    id: int
    name: str = ""
    items: tuple[ConceptItem, ...] = ()


@dataclass(frozen=True)
class NumericRange:
    """A test of a number or a date: value op, and extent for "bt" and "!bt"."""

    value: Any = None
    op: str = "gte"
    extent: Any = None


@dataclass(frozen=True)
class TextFilter:
    """A test of a text: op is "eq", "startsWith", "contains", "endsWith", or one of these after "!"."""

    text: str = ""
    op: str = "contains"


@dataclass(frozen=True)
class DateAdjustment:
    """The dates that stand for a record's: either end of it, moved by days."""

    start_with: str = "START_DATE"
    end_with: str = "END_DATE"
    start_offset: int = 0
    end_offset: int = 0


@dataclass(frozen=True)
class DomainCriteria:
    """Records of one domain. The key of a type filter is that of the domain, such as DrugType."""

    domain: str
    codeset_id: int | None = None
    first: bool = False
    date_adjustment: DateAdjustment | None = None
    occurrence_start_date: NumericRange | None = None
    occurrence_end_date: NumericRange | None = None
    age: NumericRange | None = None
    gender: tuple[Concept, ...] = ()
    record_type: tuple[Concept, ...] = ()
    visit_type: tuple[Concept, ...] = ()
    provider_specialty: tuple[Concept, ...] = ()
    value_as_number: NumericRange | None = None
    value_as_concept: tuple[Concept, ...] = ()
    value_as_string: TextFilter | None = None
    unit: tuple[Concept, ...] = ()
    range_low: NumericRange | None = None
    range_high: NumericRange | None = None
    quantity: NumericRange | None = None
    days_supply: NumericRange | None = None
    refills: NumericRange | None = None
    effective_drug_dose: NumericRange | None = None
    dose_value: NumericRange | None = None
    era_length: NumericRange | None = None
    route_concept: tuple[Concept, ...] = ()
    stop_reason: TextFilter | None = None
    lot_number: TextFilter | None = None
    correlated_criteria: CriteriaGroup | None = None


@dataclass(frozen=True)
class WindowEndpoint:
    """Days from the index date, before it where coeff is -1; without days the end of the observation period."""

    days: int | None = None
    coeff: int = 1


@dataclass(frozen=True)
class TemporalWindow:
    start: WindowEndpoint | None = None
    end: WindowEndpoint | None = None
    use_index_end: bool = False
    use_event_end: bool = False


@dataclass(frozen=True)
class Occurrence:
    """How often: exactly (0), at most (1) or at least (2) count."""

    type: int = 2
    count: int = 1
    is_distinct: bool = False


@dataclass(frozen=True)
class CorrelatedCriteria:
    criteria: DomainCriteria
    start_window: TemporalWindow | None = None
    end_window: TemporalWindow | None = None
    occurrence: Occurrence = Occurrence()
    restrict_visit: bool = False
    ignore_observation_period: bool = False


@dataclass(frozen=True)
class DemographicCriteria:
    age: NumericRange | None = None
    gender: tuple[Concept, ...] = ()
    race: tuple[Concept, ...] = ()
    ethnicity: tuple[Concept, ...] = ()
    occurrence_start_date: NumericRange | None = None
    occurrence_end_date: NumericRange | None = None


@dataclass(frozen=True)
class CriteriaGroup:
    """Members of which ALL, ANY, AT_LEAST count or AT_MOST count have to be met."""

    type: str = "ALL"
    count: int | None = None
    criteria_list: tuple[CorrelatedCriteria, ...] = ()
    demographic_criteria_list: tuple[DemographicCriteria, ...] = ()
    groups: tuple[CriteriaGroup, ...] = ()


@dataclass(frozen=True)
class InclusionRule:
    expression: CriteriaGroup
    name: str = "rule"
    description: str = ""


@dataclass(frozen=True)
class CriteriaLimit:
    type: str = "All"


@dataclass(frozen=True)
class ObservationWindow:
    prior_days: int = 0
    post_days: int = 0


@dataclass(frozen=True)
class PrimaryCriteria:
    criteria_list: tuple[DomainCriteria, ...] = ()
    observation_window: ObservationWindow = ObservationWindow()
    primary_criteria_limit: CriteriaLimit = CriteriaLimit()


@dataclass(frozen=True)
class DateOffsetStrategy:
    date_field: str = "StartDate"
    offset: int = 0


@dataclass(frozen=True)
class CustomEraStrategy:
    """The era of a code set's drug records; days_supply_override counts for their lengths."""

    drug_codeset_id: int = 0
    gap_days: int = 0
    offset: int = 0
    days_supply_override: int | None = None


@dataclass(frozen=True)
class EndStrategy:
    date_offset: DateOffsetStrategy | None = None
    custom_era: CustomEraStrategy | None = None


@dataclass(frozen=True)
class CollapseSettings:
    collapse_type: str = "ERA"
    era_pad: int = 0


@dataclass(frozen=True)
class CensorWindow:
    start_date: str | None = None
    end_date: str | None = None


@dataclass(frozen=True)
class CohortExpression:
    primary_criteria: PrimaryCriteria
    concept_sets: tuple[ConceptSet, ...] = ()
    additional_criteria: CriteriaGroup | None = None
    qualified_limit: CriteriaLimit = CriteriaLimit()
    inclusion_rules: tuple[InclusionRule, ...] = ()
    expression_limit: CriteriaLimit = CriteriaLimit()
    end_strategy: EndStrategy = EndStrategy()
    censoring_criteria: tuple[DomainCriteria, ...] = ()
    collapse_settings: CollapseSettings = CollapseSettings()
    censor_window: CensorWindow = CensorWindow()
    title: str = ""
    name: str = ""
    description: str = ""
    id: int | None = None
    cdm_version_range: str = ""


def _plain(key: str) -> str:
    """A key without case and underscores: the forms CodesetId, codesetId and codeset_id are one."""
    return key.replace("_", "").lower()


#: Keys that captions carry beside an id and that change no result.
_CAPTIONS = {"conceptsets": {"createdby", "createddate"}, "concept": {"standardconceptcaption", "invalidreason", "invalidreasoncaption"}}


def _filled(cls: type, x: Mapping, part: str) -> Any:
    hints, known = get_type_hints(cls), {_plain(f.name): f for f in fields(cls)}
    values = {}
    for key, v in x.items():
        if v is None or v in ({}, [], ""):
            continue  # sets nothing
        f = known.get(_plain(key))
        if f is None:
            if v is not False and _plain(key) not in _CAPTIONS.get(_plain(part), ()):
                raise ValueError(f"not known in {part}: {key}")
            continue
        values[f.name] = _read(hints[f.name], v, key)
    missing = [f.name for f in fields(cls) if f.name not in values and f.default is MISSING]
    if missing:
        raise ValueError(f"missing in {part}: {', '.join(missing)}")
    return cls(**values)


def _read(hint: Any, v: Any, part: str) -> Any:
    if get_origin(hint) in (Union, types.UnionType):
        hint = next(a for a in get_args(hint) if a is not type(None))
    if get_origin(hint) is tuple:
        if not isinstance(v, list | tuple):
            v = [v]
        return tuple(_read(get_args(hint)[0], i, part) for i in v)
    if hint is DomainCriteria:
        return _criterion(v)
    if hint is ConceptSet:
        return _filled(ConceptSet, {k: i for k, i in v.items() if _plain(k) != "expression"} | dict(v.get("expression") or v.get("Expression") or {}), part)
    if hint in (int, str, bool):
        return hint(v)
    return v if hint is Any else _filled(hint, v, part)


#: Keys of eras that are the same filters as those of occurrences.
_ERA_KEYS = {"erastartdate": "occurrence_start_date", "eraenddate": "occurrence_end_date"}


def _criterion(x: Mapping) -> DomainCriteria:
    if len(x) != 1:
        raise ValueError(f"not one criterion: {', '.join(x)}")
    ((kind, spec),) = x.items()
    kind = next((k for k in DOMAIN_OF if _plain(k) == _plain(kind)), None)
    if kind is None:
        raise ValueError(f"not a known criterion: {', '.join(x)}")
    # DrugType, ConditionType, ... are the type of the record itself; a visit's own is VisitType
    own = {_plain(DOMAIN_OF[kind]) + "type": "record_type"} | _ERA_KEYS
    return _filled(DomainCriteria, {"domain": DOMAIN_OF[kind]} | {own.get(_plain(k), k): v for k, v in (spec or {}).items()}, kind)


def parse(definition: str | Mapping | CohortExpression) -> CohortExpression:
    """A definition from JSON text or from nested mappings, with keys in any of the usual forms."""
    if isinstance(definition, CohortExpression):
        return definition
    return _filled(CohortExpression, json.loads(definition) if isinstance(definition, str) else definition, "definition")


def read_definitions(folder: str) -> dict[str, CohortExpression]:
    """Definitions of a driver-side folder of JSON files, by their stems."""
    return {p.stem: parse(p.read_text()) for p in sorted(Path(folder).glob("*.json"))}
