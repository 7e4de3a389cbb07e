"""Round trips through an embedded database, where Spark's distribution has one."""

import uuid

import pytest
from pyspark.sql import functions as F

from eralith.sources.database import Database


@pytest.fixture
def db(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db{uuid.uuid4().hex};create=true"
    d = Database(spark, url, {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    try:
        d.tables()
    except Exception as e:  # noqa: BLE001
        if "ClassNotFound" in str(e) or "No suitable driver" in str(e):
            pytest.skip("no embedded database")
        raise
    return d


def test_round_trip(spark, db):
    df = spark.range(500).selectExpr("id as person_id", "date_add(date'2000-01-01', cast(id % 90 as int)) as start_date", "concat('it''s ', id) as note", "cast(id as double) / 7 as Value")
    more = spark.createDataFrame([(None, None, None, None), (10_000, None, "", 1.5)], "person_id long, start_date date, note string, Value double")
    db.write(df.unionByName(more), "events", "first", partitions=3)
    assert db.tables() == ["events"] and db.bounds("events", "person_id") == (0, 10_000)
    back = db.read("events", partitions=8)
    assert back.columns == ["person_id", "start_date", "note", "value", "batch_name"] and back.rdd.getNumPartitions() == 8
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, back.drop("batch_name").collect()), key=key) == sorted(map(tuple, df.unionByName(more).collect()), key=key)
    assert db.clinical()["events"].count() == 502 and db.drop("events") and not db.drop("events") and db.tables() == []


def test_filters_and_columns_go_down(spark, db):
    db.write(spark.range(100).selectExpr("id as person_id", "id % 5 as concept_id", "'x' as note"), "events", "a")
    d = db.read("events").where("concept_id = 3 and person_id > 50").select("person_id")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(concept_id,3)" in plan and "GreaterThan(person_id,50)" in plan and "note" not in plan.split("ReadSchema")[1]
    assert sorted(r[0] for r in d.collect()) == list(range(53, 100, 5))


def test_batches_are_written_once(spark, db):
    """A batch again replaces itself, other batches stay; a failed write leaves the table as it was."""
    df = spark.range(10).withColumnRenamed("id", "subject_id")
    for _ in range(2):
        db.write(df, "cohort", "it's")
    db.write(df.limit(3), "cohort", "other")
    count = lambda: {r.batch_name: r["count"] for r in db.read("cohort").groupBy("batch_name").count().collect()}
    assert count() == {"it's": 10, "other": 3} and db.tables() == ["cohort"]
    with pytest.raises(Exception, match="no such thing|USER_RAISED_EXCEPTION|ZERO"):
        db.write(df.withColumn("subject_id", F.when(F.col("subject_id") > 4, F.raise_error(F.lit("no such thing"))).otherwise(F.col("subject_id"))), "cohort", "it's")
    assert count() == {"it's": 10, "other": 3}
    db.write(df.limit(4), "cohort", "it's")
    assert count() == {"it's": 4, "other": 3} and db.tables() == ["cohort"]
    with pytest.raises(ValueError, match="batch_name"):
        db.write(df.withColumn("batch_name", F.lit("x")), "cohort", "x")
    with pytest.raises(Exception, match="(?i)syntax|nothing"):
        db.execute("DELETE FROM cohort", "nothing at all")
    assert sum(count().values()) == 7


def test_rows_written_twice_are_not_taken_in(spark, db, monkeypatch):
    """A task that wrote its rows and was repeated all the same."""
    df = spark.range(4).withColumnRenamed("id", "person_id")
    db.write(df, "events", "a")
    ask = Database.ask

    def doubled(self, sql):
        if "DISTINCT" in sql:
            staging = sql.rsplit(" ", 1)[1]
            self.execute(f"INSERT INTO {staging} SELECT * FROM {staging}")
        return ask(self, sql)

    monkeypatch.setattr(Database, "ask", doubled)
    with pytest.raises(RuntimeError, match="written twice"):
        db.write(df, "events", "a")
    monkeypatch.setattr(Database, "ask", ask)
    assert db.read("events").count() == 4


def test_empty_table(spark, db):
    db.write(spark.createDataFrame([], "person_id long, v string"), "nobody", "a")
    d = db.read("nobody")
    assert d.count() == 0 and db.bounds("nobody", "person_id") is None and d.columns == ["person_id", "v", "batch_name"]
