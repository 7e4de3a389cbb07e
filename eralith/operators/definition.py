"""Cohorts from declarative definitions: primary events, criteria groups, inclusion rules, exits, eras.

The plan grows by one scan and one branch for each criterion, never by the number of rules before it: all criteria of all
rules meet the events in one join, one aggregate counts each criterion's records, and rules are columns over the counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eralith.functions.kernels import closure, islands, pick
from eralith.operators.definition_types import (
    CohortExpression,
    Concept,
    CorrelatedCriteria,
    CriteriaGroup,
    CriteriaLimit,
    CustomEraStrategy,
    DemographicCriteria,
    DomainCriteria,
    NumericRange,
    TemporalWindow,
    TextFilter,
    WindowEndpoint,
    parse,
    read_definitions,
)
from eralith.sources.clinical import DOMAINS, Clinical

__all__ = ["generate", "generate_set", "parse", "read_definitions"]

_EVENT = ["event_id", "person_id", "start_date", "end_date", "visit_id", "o_start", "o_end"]
#: Filter of a criterion -> column of the domain's table.
_NUMBERS = {x: x for x in ("value_as_number", "range_low", "range_high", "quantity", "days_supply", "refills", "effective_drug_dose", "dose_value")}
_CONCEPTS = {"value_as_concept": "value_as_concept_id", "unit": "unit_concept_id", "route_concept": "route_concept_id"}
_TEXTS = {x: x for x in ("value_as_string", "stop_reason", "lot_number")}


def _codes(c: Clinical, definition: CohortExpression) -> DataFrame:
    """(name, concept_id) of all concept sets: items, descendants and mapped codes less the excluded ones."""
    spark = c["person"].sparkSession
    items = [(s, i) for s in definition.concept_sets for i in s.items]
    rows = [(str(s.id), i.concept.concept_id, i.include_descendants, i.is_excluded, i.include_mapped) for s, i in items]
    seeds = spark.createDataFrame(rows, "name string, concept_id long, include_descendants boolean, is_excluded boolean, include_mapped boolean")
    if any(i.include_mapped for _, i in items):
        maps = c["concept_relationship"].where("relationship_id = 'Maps to'").select(F.col("concept_id_1").alias("_from"), F.col("concept_id_2").alias("concept_id"))
        down = seeds.where("include_mapped").join(c["concept_ancestor"], F.col("concept_id") == F.col("ancestor_concept_id"), "left")
        down = down.select("name", F.when(F.col("include_descendants"), F.col("descendant_concept_id")).otherwise(F.col("concept_id")).alias("to"), "is_excluded")
        down = down.unionByName(seeds.where("include_mapped").select("name", F.col("concept_id").alias("to"), "is_excluded")).distinct()
        # a code is brought in by the standard code that it maps to
        mapped = down.join(maps, down["to"] == maps["concept_id"]).select("name", F.col("_from").alias("concept_id"), F.lit(False).alias("include_descendants"), "is_excluded", F.lit(False).alias("include_mapped"))
        seeds = seeds.unionByName(mapped)
    return closure(seeds.drop("include_mapped"), c["concept_ancestor"])


def _compare(value: Column, r: NumericRange, date: bool = False) -> Column:
    a, b = (F.lit(x).cast("date") if date else F.lit(x) for x in (r.value, r.extent))
    tests = {
        "gt": lambda: value > a, "gte": lambda: value >= a, "lt": lambda: value < a, "lte": lambda: value <= a, "eq": lambda: value == a,
        "neq": lambda: value != a, "bt": lambda: value.between(a, b), "!bt": lambda: ~value.between(a, b),
    }
    if r.op not in tests:
        raise ValueError(f"not a known comparison: {r.op}")
    return tests[r.op]()


def _text(value: Column, f: TextFilter) -> Column:
    test = {"eq": lambda: value == f.text, "startsWith": lambda: value.startswith(f.text), "endsWith": lambda: value.endswith(f.text), "contains": lambda: value.contains(f.text)}
    if f.op.lstrip("!") not in test:
        raise ValueError(f"not a known text comparison: {f.op}")
    return ~test[f.op[1:]]() if f.op.startswith("!") else test[f.op]()


def _among(value: Column, concepts: tuple[Concept, ...]) -> Column:
    return value.isin([x.concept_id for x in concepts])


def _criterion(c: Clinical, codes: DataFrame, spec: DomainCriteria) -> DataFrame:
    """(person_id, start_date, end_date, visit_id) of one criterion's records; a missing end is a day after the start."""
    d = DOMAINS[spec.domain]
    if d.table not in c:
        raise ValueError(f"no table {d.table}")
    table = c[d.table]

    def column(name: str | None, wanted_by: str) -> Column:
        if name is None or name not in table.columns:
            raise ValueError(f"{wanted_by}: no such column in {d.table}")
        return F.col(name)

    tests = [_compare(column(_NUMBERS[k], k), getattr(spec, k)) for k in _NUMBERS if getattr(spec, k)]
    tests += [_among(column(_CONCEPTS[k], k), getattr(spec, k)) for k in _CONCEPTS if getattr(spec, k)]
    tests += [_text(column(_TEXTS[k], k), getattr(spec, k)) for k in _TEXTS if getattr(spec, k)]
    if spec.era_length:
        tests.append(_compare(F.datediff(d.end, d.start), spec.era_length))
    if spec.record_type:
        tests.append(_among(column(d.type, "type"), spec.record_type))
    ends = {"START_DATE": F.col(d.start), "END_DATE": F.col(d.end)}
    adjust = spec.date_adjustment
    start = F.date_add(ends[adjust.start_with], adjust.start_offset) if adjust else ends["START_DATE"]
    end = F.date_add(ends[adjust.end_with], adjust.end_offset) if adjust else ends["END_DATE"]
    if d.start != d.end or adjust:
        end = F.coalesce(end, F.date_add(start, 1))
    visit = F.col("visit_occurrence_id") if "visit_occurrence_id" in table.columns else F.lit(None)
    provider = F.col("provider_id") if "provider_id" in table.columns else F.lit(None)
    concept = F.col(d.concept).cast("long") if d.concept else F.lit(None).cast("long")
    e = table.where(reduce(and_, tests)) if tests else table
    e = e.select("person_id", concept.alias("concept_id"), start.alias("start_date"), end.alias("end_date"), visit.cast("long").alias("visit_id"), provider.cast("long").alias("provider_id"))
    e = e.where("start_date <= end_date")
    if spec.codeset_id is not None and d.concept:
        e = e.join(codes.where(F.col("name") == str(spec.codeset_id)).select("concept_id"), "concept_id", "left_semi")
    if spec.occurrence_start_date:
        e = e.where(_compare(F.col("start_date"), spec.occurrence_start_date, date=True))
    if spec.occurrence_end_date:
        e = e.where(_compare(F.col("end_date"), spec.occurrence_end_date, date=True))
    if spec.visit_type:
        seen = c["visit_occurrence"].where(_among(F.col("visit_concept_id"), spec.visit_type))
        e = e.join(seen.select(F.col("visit_occurrence_id").alias("visit_id")), "visit_id", "left_semi")
    if spec.provider_specialty:
        e = e.join(c["provider"].where(_among(F.col("specialty_concept_id"), spec.provider_specialty)).select("provider_id"), "provider_id", "left_semi")
    if spec.age or spec.gender:
        who = c["person"].select("person_id", "gender_concept_id", "year_of_birth")
        e = e.join(who, "person_id").where(_demographic(DemographicCriteria(age=spec.age, gender=spec.gender))).drop("gender_concept_id", "year_of_birth")
    if spec.first:
        e = pick(e, ["person_id"], ["start_date", "end_date", "concept_id", "visit_id"])
    e = e.select("person_id", "start_date", "end_date", "visit_id")
    if spec.correlated_criteria:
        e = _with_period(c, e.distinct(), 0, 0)
        e = _tested(c, codes, e, [spec.correlated_criteria]).where("g0").select("person_id", "start_date", "end_date", "visit_id")
    return e


def _demographic(d: DemographicCriteria) -> Column:
    """A test over a person's columns and start_date, end_date."""
    tests = [F.lit(True)]
    if d.age:
        tests.append(_compare(F.year("start_date") - F.col("year_of_birth"), d.age))
    tests += [_among(F.col(f"{k}_concept_id"), getattr(d, k)) for k in ("gender", "race", "ethnicity") if getattr(d, k)]
    tests += [_compare(F.col(x), getattr(d, f"occurrence_{x}"), date=True) for x in ("start_date", "end_date") if getattr(d, f"occurrence_{x}")]
    return reduce(and_, tests)


def _with_period(c: Clinical, events: DataFrame, prior: int, post: int) -> DataFrame:
    """Events inside an observation period, with enough days before and after, and an id that stands for all their columns."""
    op = c["observation_period"].select("person_id", F.col("observation_period_start_date").alias("o_start"), F.col("observation_period_end_date").alias("o_end"))
    e = events.join(op, "person_id").where((F.date_add("o_start", prior) <= F.col("start_date")) & (F.date_sub("o_end", post) >= F.col("start_date")))
    return e.withColumn("event_id", F.struct("person_id", "start_date", "end_date", "visit_id")).select(_EVENT)


def _members(group: CriteriaGroup) -> Iterator[CorrelatedCriteria]:
    yield from group.criteria_list
    for g in group.groups:
        yield from _members(g)


def _demographics(group: CriteriaGroup) -> Iterator[DemographicCriteria]:
    yield from group.demographic_criteria_list
    for g in group.groups:
        yield from _demographics(g)


def _inside(m: CorrelatedCriteria) -> Column:
    """Whether a record (_s, _e, _v) lies where the event's row wants it."""
    tests = [F.lit(True)]
    if not m.ignore_observation_period:
        tests += [F.col("_s") >= F.col("o_start"), F.col("_s") <= F.col("o_end")]
    if m.restrict_visit:
        tests.append(F.col("_v") == F.col("visit_id"))

    def bound(p: WindowEndpoint | None, index: Column) -> Column | None:
        return None if p is None or p.days is None else F.date_add(index, p.days * p.coeff)

    def within(w: TemporalWindow | None, date: str) -> None:
        if w is None:
            return
        index, at = F.col("end_date" if w.use_index_end else "start_date"), F.col("_e" if w.use_event_end else date)
        lo, hi = bound(w.start, index), bound(w.end, index)
        tests.extend([at >= lo] if lo is not None else [])
        tests.extend([at <= hi] if hi is not None else [])

    within(m.start_window, "_s")
    within(m.end_window, "_e")
    return reduce(and_, tests)


def _tested(c: Clinical, codes: DataFrame, events: DataFrame, groups: list[CriteriaGroup]) -> DataFrame:
    """events with a column g0, g1, ... for each group: whether the event meets it. Criteria without records count zero."""
    members = [m for g in groups for m in _members(g)]
    number = {id(m): k for k, m in enumerate(members)}
    out = events
    if members:
        records = [_criterion(c, codes, m.criteria).select(F.col("person_id").alias("_p"), F.col("start_date").alias("_s"), F.col("end_date").alias("_e"), F.col("visit_id").alias("_v"), F.lit(k).alias("_m")) for k, m in enumerate(members)]
        records = reduce(DataFrame.unionByName, records)
        fits = reduce(lambda done, k: done.when(F.col("_m") == k, _inside(members[k])), range(1, len(members)), F.when(F.col("_m") == 0, _inside(members[0])))
        joined = events.join(records, (F.col("person_id") == F.col("_p")) & fits, "left")
        count = lambda k, m: F.size(F.collect_set(F.when(F.col("_m") == k, F.col("_s")))) if m.occurrence.is_distinct else F.count(F.when(F.col("_m") == k, 1))
        out = joined.groupBy(events.columns).agg(*(count(k, m).alias(f"_n{k}") for k, m in enumerate(members)))
    if any(True for g in groups for _ in _demographics(g)):
        who = c["person"]
        wanted = [x for x in ("gender_concept_id", "race_concept_id", "ethnicity_concept_id", "year_of_birth") if x in who.columns]
        out = out.join(who.select("person_id", *wanted), "person_id", "left")

    def met(m: CorrelatedCriteria) -> Column:
        n, want = F.col(f"_n{number[id(m)]}"), m.occurrence.count
        return {0: n == want, 1: n <= want, 2: n >= want}[m.occurrence.type]

    def holds(g: CriteriaGroup) -> Column:
        parts = [met(m) for m in g.criteria_list] + [_demographic(d) for d in g.demographic_criteria_list] + [holds(x) for x in g.groups]
        if not parts:
            return F.lit(True)
        n = reduce(lambda a, b: a + b, (F.coalesce(p, F.lit(False)).cast("int") for p in parts))
        kinds = {"ALL": n == len(parts), "ANY": n >= 1, "AT_LEAST": n >= (g.count or 0), "AT_MOST": n <= (g.count or 0)}
        if g.type.upper() not in kinds:
            raise ValueError(f"not a known type of group: {g.type}")
        return kinds[g.type.upper()]

    return out.select(*events.columns, *(holds(g).alias(f"g{k}") for k, g in enumerate(groups)))


def _limited(flag: Column, limit: CriteriaLimit) -> Column:
    """Of each person's events with the flag the first, the last, or all."""
    if limit.type == "All":
        return flag
    order = [F.col(x).desc() if limit.type == "Last" else F.col(x).asc() for x in ("start_date", "end_date", "visit_id")]
    return flag & (F.row_number().over(Window.partitionBy("person_id", flag).orderBy(*order)) == 1)


def _with_era_end(c: Clinical, codes: DataFrame, events: DataFrame, era: CustomEraStrategy) -> DataFrame:
    """_era_end: end of the era of the code set's drug records that holds the event's start, plus an offset; else its own end."""
    drug = _criterion(c, codes, DomainCriteria("drug", codeset_id=era.drug_codeset_id))
    if era.days_supply_override is not None:
        drug = drug.withColumn("end_date", F.date_add("start_date", era.days_supply_override))
    eras = islands(drug, ["person_id"], "start_date", "end_date", era.gap_days)
    e = eras.select(F.col("person_id").alias("_p"), F.col("start_date").alias("_s"), F.date_add("end_date", era.offset).alias("_x"), F.col("end_date").alias("_e"))
    held = events.join(e, (F.col("person_id") == F.col("_p")) & F.col("start_date").between(F.col("_s"), F.col("_e")), "left")
    return held.groupBy(events.columns).agg(F.max("_x").alias("_era_end")).withColumn("_era_end", F.coalesce("_era_end", "end_date"))


def generate_set(c: Clinical, definitions: Mapping[str, str | Mapping | CohortExpression]) -> tuple[DataFrame, DataFrame, dict[int, str]]:
    """Cohorts and attrition of several named definitions, numbered in the order of their names, and the names."""
    names = dict(enumerate(sorted(definitions), 1))
    made = [(k, *generate(c, definitions[n], k)) for k, n in names.items()]
    cohort = reduce(DataFrame.unionByName, [x for _, x, _ in made])
    attrition = reduce(DataFrame.unionByName, [x.withColumn("cohort_definition_id", F.lit(k).cast("long")) for k, _, x in made])
    return cohort, attrition, names


def qualified(c: Clinical, d: CohortExpression, codes: DataFrame) -> tuple[DataFrame, list[str]]:
    """Initial events with a column s1, s2, ... for each step (whether the event is still in after it), and the steps' names."""
    primary, w = d.primary_criteria, d.primary_criteria.observation_window
    events = reduce(DataFrame.unionByName, [_criterion(c, codes, i) for i in primary.criteria_list]).distinct()
    events = _with_period(c, events, w.prior_days, w.post_days)
    events = events.withColumn("s1", _limited(F.lit(True), primary.primary_criteria_limit)).where("s1")
    names, groups = ["Initial events"], [r.expression for r in d.inclusion_rules]
    groups = [d.additional_criteria, *groups] if d.additional_criteria else groups
    if not groups:
        return events, names
    events = _tested(c, codes, events, groups)
    if d.additional_criteria:
        events = events.withColumn("s2", _limited(F.col("g0"), d.qualified_limit))
        names.append("Additional criteria")
    for k, rule in enumerate(d.inclusion_rules, len(names)):
        events = events.withColumn(f"s{k + 1}", F.col(f"s{k}") & F.col(f"g{k - 1}"))
        names.append(rule.name)
    return events.drop(*(f"g{k}" for k in range(len(groups)))), names


def generate(c: Clinical, definition: str | Mapping | CohortExpression, number: int = 1) -> tuple[DataFrame, DataFrame]:
    """(cohort, attrition) of a definition. attrition: (reason_id, reason, number_records, number_subjects), one row a step."""
    d = parse(definition)
    codes = _codes(c, d)
    flagged, names = qualified(c, d, codes)
    steps = [f"s{k}" for k in range(1, len(names) + 1)]
    events = flagged.where(steps[-1]).select(*_EVENT)
    if d.expression_limit.type != "All":
        events = pick(events, ["person_id"], ["start_date", "end_date", "visit_id"], last=d.expression_limit.type == "Last")
    offset, era = d.end_strategy.date_offset, d.end_strategy.custom_era
    if offset:
        end = F.date_add("start_date" if offset.date_field.lower() == "startdate" else "end_date", offset.offset)
    elif era:
        events, end = _with_era_end(c, codes, events, era), F.col("_era_end")
    else:
        end = F.col("o_end")
    out = events.withColumn("_end", F.least(end, "o_end"))
    if d.censoring_criteria:
        stop = reduce(DataFrame.unionByName, [_criterion(c, codes, i) for i in d.censoring_criteria]).select(F.col("person_id").alias("_p"), F.col("start_date").alias("_s"))
        out = out.join(stop, (F.col("person_id") == F.col("_p")) & (F.col("_s") >= F.col("start_date")), "left").groupBy(out.columns).agg(F.min("_s").alias("_s"))
        out = out.withColumn("_end", F.least("_end", "_s"))
    for side, column, clamp in ((d.censor_window.start_date, "start_date", F.greatest), (d.censor_window.end_date, "_end", F.least)):
        if side:
            out = out.withColumn(column, clamp(F.col(column), F.lit(side).cast("date")))
    out = out.where("start_date <= _end")
    cohort = out.select(F.lit(number).cast("long").alias("cohort_definition_id"), F.col("person_id").alias("subject_id"), F.col("start_date").alias("cohort_start_date"), F.col("_end").alias("cohort_end_date"))
    cohort = islands(cohort, ["cohort_definition_id", "subject_id"], "cohort_start_date", "cohort_end_date", d.collapse_settings.era_pad)
    # records and persons of all steps by one pass: first each person's, then their sums
    person = flagged.groupBy("person_id").agg(*(F.sum(F.col(s).cast("int")).alias(s) for s in steps))
    total = person.agg(*(x for s in steps for x in (F.sum(s).alias(f"r_{s}"), F.sum((F.col(s) > 0).cast("int")).alias(f"p_{s}"))))
    rows = F.array(*(F.struct(F.lit(k).alias("reason_id"), F.lit(n).alias("reason"), F.coalesce(f"r_{s}", F.lit(0)).cast("long").alias("number_records"), F.coalesce(f"p_{s}", F.lit(0)).cast("long").alias("number_subjects")) for k, (s, n) in enumerate(zip(steps, names, strict=True), 1)))
    return cohort, total.select(F.inline(rows))
