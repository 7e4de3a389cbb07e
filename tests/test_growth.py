"""Plans of queries whose steps must not grow faster than their tables."""

import re

import __spark_entry__ as entry
from tests.test_queries import SF, needs_data


def plan(spark, name):
    return entry.queries()[name](spark, str(SF))._jdf.queryExecution().optimizedPlan().toString()


@needs_data
def test_unsampled_checks_do_not_count_records_first(spark):
    """The records are read for the plain figures, the histogram and its look-up, and never joined to their totals."""
    assert plan(spark, "diagnostics_quantity").count("Relation [l_orderkey") == 3


@needs_data
def test_codes_in_use_read_the_records_once(spark):
    """However many tables the codelist is a union of."""
    assert plan(spark, "vocabulary_in_use").count("Relation [l_orderkey") == 1


@needs_data
def test_dose_eras_are_swept_in_parts_of_bounded_size(spark, monkeypatch):
    """One exchange after the joins, into more parts the larger the tables are, and nothing that holds a task's points in a map."""
    from eralith.functions import sweeps

    size = sum((SF / f"{t}.parquet").stat().st_size for t in ("lineitem", "orders", "part"))
    assert "Aggregate" not in plan(spark, "connector_dose_eras")
    for a_part in (size // 25, size // 90):
        monkeypatch.setattr(sweeps, "BYTES_A_PART", a_part)
        for name in ("connector_dose_eras", "definition_dose_era"):
            dealt = dict(re.findall(r"RepartitionByExpression \[(\w+)#[^\]]*\], (\d+)", plan(spark, name)))
            assert int(dealt["person_id"]) == -(-size // a_part)
            assert int(dealt["l_orderkey"]) == int(dealt["o_orderkey"]) > 16


@needs_data
def test_large_joins_deal_tables_out_once(spark, monkeypatch):
    """Parts fewer than the session's would be dealt out a second time."""
    from eralith.functions import sweeps

    size = sum((SF / f"{t}.parquet").stat().st_size for t in ("lineitem", "orders"))
    monkeypatch.setattr(sweeps, "BYTES_A_PART", size // 20)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        assert set(re.findall(r"RepartitionByExpression \[[lo]_orderkey#\d+L?\], (\d+)", plan(spark, "definition_dose_era"))) == {"40"}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_parts_of_tables_in_memory(spark):
    from eralith.functions.sweeps import both_by_size, by_size, parts

    df = spark.createDataFrame([(1,), (2,)], "k long")
    assert parts(df) is None and both_by_size(df, "k", df, "k") == (df, df) and by_size(df, "k").count() == 2
