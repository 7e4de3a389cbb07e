"""Each query against its SQL in DuckDB on the smallest driver tables, where they are there."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry
from eralith.plans import catalog

SF = Path(entry.SMALLEST)
needs_data = pytest.mark.skipif(not SF.exists(), reason="driver tables are absent")


def plain(rows):
    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 5) + 0.0
        if type(v).__name__ in ("int", "str", "bool", "NoneType"):
            return v
        return str(v)

    return sorted(([value(v) for v in r] for r in rows), key=str)


@needs_data
@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, str(SF))
    rows = df.collect()
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in SF.iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(df.columns)
    got = plain([[r[c] for c in order] for r in rows])
    expected = plain([[r[names.index(c)] for c in order] for r in want.fetchall()])
    assert got == expected and rows


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() == 2 and set(catalog.ORACLE_SQL) <= set(entry.queries())


@needs_data
def test_suppression_counts_the_whole_cohort(spark):
    """Some cells are shown and some suppressed, and no subject is left out before cells are counted."""
    from eralith.sources.clinical import project

    rows = catalog.QUERIES["result_suppressed_strata"](spark, str(SF)).collect()
    shown, hidden = [int(r["count"]) for r in rows if r["count"] != "-"], sum(r["count"] == "-" for r in rows)
    n = catalog.target(project(spark, str(SF))).count()
    assert hidden and sum(shown) + hidden <= n <= sum(shown) + 7 * hidden
