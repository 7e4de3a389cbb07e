"""Arguments, names, schema catalogue, files, cohort tables, formats and hand-written patients."""

import datetime as dt
import json
import math

import pytest


def test_checks(spark):
    from eralith.functions import checks as k

    assert k.assert_character(["a", "b"], length=2) == ["a", "b"] and k.assert_character(None, null=True) is None
    assert k.assert_choice("a", ["a", "b"]) == "a" and k.assert_numeric(3, low=0, integer=True) == 3 and k.assert_logical(True) is True
    assert k.assert_list([1, 2], of=int) == [1, 2] and k.assert_date(dt.date(2000, 1, 1)) and k.assert_class(1, int) == 1 and k.assert_true(True) is None
    df = spark.range(2)
    assert k.assert_table_columns(df, ["id"]) is df
    for bad in (
        lambda: k.assert_character(1, "a1"), lambda: k.assert_character([None], "a1"), lambda: k.assert_choice("c", ["a"], "a1"), lambda: k.assert_numeric(True, "a1"),
        lambda: k.assert_numeric(5, "a1", high=4), lambda: k.assert_numeric(1.5, "a1", integer=True), lambda: k.assert_list("x", "a1"), lambda: k.assert_list([1], "a1", of=str),
        lambda: k.assert_date("2000", "a1"), lambda: k.assert_logical(1, "a1"), lambda: k.assert_class(1, str, "a1"), lambda: k.assert_true(False, "a1"), lambda: k.assert_table_columns(df, ["x"], "a1"),
    ):
        with pytest.raises(ValueError, match="a1"):
            bad()


def test_names():
    from eralith.functions.naming import format_name_style, validate_windows, window_name

    assert validate_windows((0, math.inf)) == [(0, None)] and validate_windows([(-365, -1), (None, 5)]) == [(-365, -1), (None, 5)]
    assert [window_name(w) for w in ((0, math.inf), (-365, -1), (-math.inf, math.inf), (None, 0))] == ["0_to_inf", "m365_to_m1", "minf_to_inf", "minf_to_0"]
    assert format_name_style("{cohort_name}_{window_name}", cohort_name="My Cohort", window_name="0_to_inf") == "my_cohort_0_to_inf"
    assert format_name_style("{x}", x="drugExposure ABCDef-9") == "drug_exposure_abc_def_9"
    for w in ([(1, 0)], [(math.inf, math.inf)], [(1, 2, 3)]):
        with pytest.raises(ValueError):
            validate_windows(w)


def test_schema():
    from eralith.sources import schema as s

    c = s.CdmSchema("5.4")
    assert {"person", "measurement", "visit_detail"} <= set(c.table_names_in_group("clinical")) and c.table_names_in_group("derived") == ["condition_era", "drug_era", "dose_era"]
    assert c.validate_columns("person", ["PERSON_ID", "gender_concept_id", "year_of_birth"]) == ["race_concept_id", "ethnicity_concept_id"]
    assert c.required_fields_for_table("measurement") == ["measurement_id", "person_id", "measurement_concept_id", "measurement_date", "measurement_type_concept_id"]
    assert c.tables["drug_exposure"].spark["quantity"].dataType.simpleString() == "double" and c.tables["drug_exposure"].start == "drug_exposure_start_date"
    assert s.start_date_column("measurement") == s.end_date_column("measurement") == "measurement_date" and s.end_date_column("cohort") == "cohort_end_date"
    assert s.standard_concept_id_column("drug_exposure") == "drug_concept_id" and s.source_concept_id_column("condition_occurrence") == "condition_source_concept_id"
    assert s.person_id_column(["subject_id"]) == "subject_id" and "concept" in s.tbl_group(["vocab", "clinical"]) and len(s.RESULT_FIELDS) == 13
    for bad in (lambda: c.validate_columns("nothing", []), lambda: s.start_date_column("concept"), lambda: s.source_concept_id_column("drug_era"), lambda: s.person_id_column(["x"]), lambda: s.CdmSchema("4")):
        with pytest.raises(ValueError):
            bad()


def test_files(spark, tmp_path):
    from eralith.operators import results as rs
    from eralith.sources import exchange as x

    codes = spark.createDataFrame([("a, b", 2), ("a, b", 1), ("c", 7)], "name string, concept_id long")
    for kind in ("csv", "json"):
        x.export_codelist(codes, f"{tmp_path}/{kind}", kind)
        assert sorted(map(tuple, x.import_codelist(spark, f"{tmp_path}/{kind}", kind).collect())) == [("a, b", 1), ("a, b", 2), ("c", 7)]
    sets = {"one": [{"concept_id": 5, "include_descendants": True}, {"concept_id": 6, "is_excluded": True}]}
    x.export_concept_set_expression(sets, f"{tmp_path}/sets")
    assert json.loads((tmp_path / "sets/one.json").read_text())["items"][0]["concept"] == {"CONCEPT_ID": 5}
    got = x.import_concept_set_expression(f"{tmp_path}/sets")["one"]
    assert [(i["concept_id"], i["is_excluded"], i["include_descendants"], i["include_mapped"]) for i in got] == [(5, False, True, False), (6, True, False, False)]
    assert x.import_concept_set_expression(f"{tmp_path}/sets/one.json") == {"one": got}
    wide = spark.createDataFrame([("x", 3, 1.5)], "cohort_name string, count long, mean double")
    result = rs.melt(wide, ["cohort_name"], [], "v", {"count": "integer", "mean": "numeric"})
    settings = spark.createDataFrame([(1, "kind", "5")], "result_id long, result_type string, min_cell_count string")
    x.export_summarised_result(result, settings, f"{tmp_path}/result")
    again, told = x.import_summarised_result(spark, f"{tmp_path}/result")
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(again) == plain(result) and told.select(settings.columns).collect() == settings.collect()


def test_formats(spark):
    from eralith.operators import results as rs

    rows = [(1, "a", "count", "integer", "1234567"), (1, "a", "mean", "numeric", "-1234.567"), (1, "a", "percentage", "percentage", "12.34"), (1, "b", "count", "integer", "-"), (1, "b", "name", "character", "12"), (2, "c", "count", "integer", None)]
    df = spark.createDataFrame(rows, "result_id long, k string, estimate_name string, estimate_type string, estimate_value string")
    value = lambda d: {(r.k, r.estimate_name): r.estimate_value for r in d.collect()}
    got = value(rs.format_estimate_value(df))
    assert got == {("a", "count"): "1,234,567", ("a", "mean"): "-1,234.57", ("a", "percentage"): "12.3", ("b", "count"): "-", ("b", "name"): "12", ("c", "count"): None}
    assert value(rs.format_estimate_value(df, {"numeric": 1}, ",", "."))["a", "mean"] == "-1.234,6"
    named = value(rs.format_estimate_name(df, {"N (%)": "<count> (<percentage>%)"}, ["result_id", "k"]))
    assert named == {("a", "N (%)"): "1234567 (12.34%)", ("a", "mean"): "-1234.567", ("b", "name"): "12"}
    settings = spark.createDataFrame([(1, "7"), (2, None)], "result_id long, min_cell_count string")
    assert value(rs.format_min_cell_count(df, settings))["b", "count"] == "<7"
    assert rs.filter_settings(df, settings, min_cell_count="7").count() == 5
    wide = rs.format_header(df.where("k = 'a'").drop("estimate_type"), ["estimate_name"], [["count"], ["mean"]])
    assert wide.first().asDict() == {"result_id": 1, "k": "a", "count": "1234567", "mean": "-1234.567"}


def test_cohort_table(spark):
    from eralith.operators.cohort_table import CohortTable
    from eralith.operators.summaries import available_grouping, summarise_cohort_count

    e = spark.sql("SELECT * FROM VALUES (1L, 10L, DATE'2000-01-01', DATE'2000-02-01'), (1L, 10L, DATE'2001-01-01', DATE'2001-02-01'), (1L, 11L, DATE'2000-01-01', DATE'2000-02-01'), (2L, 12L, DATE'2000-01-01', DATE'2000-02-01') t(cohort_definition_id, subject_id, cohort_start_date, cohort_end_date)")
    t = CohortTable.of(e)
    assert {r.cohort_definition_id: (r.number_records, r.number_subjects) for r in t.counts.collect()} == {1: (3, 2), 2: (1, 1)}
    after = t.step("early", e.where("cohort_start_date < '2001-01-01'")).step("none of 2", e.where("cohort_start_date < '2001-01-01' and cohort_definition_id = 1"))
    got = {(r.cohort_definition_id, r.reason_id): (r.reason, r.number_records, r.excluded_records, r.excluded_subjects) for r in after.attrition.collect()}
    assert got == {(1, 1): ("Initial qualifying events", 3, 0, 0), (1, 2): ("early", 2, 1, 0), (1, 3): ("none of 2", 2, 0, 0), (2, 1): ("Initial qualifying events", 1, 0, 0), (2, 2): ("early", 1, 0, 0), (2, 3): ("none of 2", 0, 1, 1)}
    one = after.filter_cohort_id([1])
    assert one.settings.count() == 1 and one.attrition.count() == 3 and t.cohort_id("cohort_2").first()[0] == 2
    assert {r.cohort_name for r in t.add_cohort_name().collect()} == {"cohort_1", "cohort_2"}
    assert available_grouping(summarise_cohort_count(t)[0]) == ["cohort_name"]
    with pytest.raises(ValueError, match="cohort_end_date"):
        CohortTable.of(e.drop("cohort_end_date"))


def test_patients(spark, tmp_path):
    from eralith.operators.cohort import concept_cohort  # noqa: F401
    from eralith.sources.clinical import validated, with_eras
    from eralith.sources.patients import generate_test_tables, patients_cdm, read_patients, validate_patient_data

    tables = generate_test_tables(3, 2)
    assert validate_patient_data(tables) == []
    (tmp_path / "p.json").write_text(json.dumps(tables))
    c = validated(patients_cdm(spark, f"{tmp_path}/p.json"))
    assert c["person"].count() == 3 and c["measurement"].count() == 6 and dict(c["drug_exposure"].dtypes)["quantity"] == "double" and c["death"].count() == 0
    assert with_eras(c)["condition_era"].count() == 6
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv/person.csv").write_text("person_id,gender_concept_id,year_of_birth,race_concept_id,ethnicity_concept_id\n1,8507,1950,0,\n")
    rows = read_patients(f"{tmp_path}/csv")
    assert rows["person"][0]["ethnicity_concept_id"] is None
    wrong = validate_patient_data(rows | {"death": [{"person_id": 9, "death_date": "2000-01-01", "x": 1}], "nothing": []})
    assert len(wrong) == 4
    with pytest.raises(ValueError, match="ethnicity"):
        patients_cdm(spark, rows)
    with pytest.raises(ValueError, match="person lacks race_concept_id"):
        from eralith.sources.clinical import Clinical

        validated(Clinical({"person": c["person"].drop("race_concept_id")}))


def test_catalog_tables(spark):
    from eralith.operators.diagnostics import benchmark, snapshot_with_source
    from eralith.sources.clinical import drop_table, write_table
    from eralith.sources.mock import mock_clinical

    name = "surface_probe"
    assert write_table(spark.range(3), name).count() == 3 and write_table(spark.range(2), name, "append").count() == 5
    assert drop_table(spark, name) and not drop_table(spark, name)
    c = mock_clinical(spark, 20)
    assert len(benchmark(c)) == 6 and snapshot_with_source(c).first().asDict()["cdm_name"] == "mock"
