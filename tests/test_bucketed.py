"""Bucketed logs give the same daily results, and their plans move no rows."""

import pytest

from prepcast.operators import daily, quality
from prepcast.plans import tables as T
from prepcast.sources.bucketed import bucketed, bucketed_logs
from tests.paths import SF_SMALL


@pytest.fixture(scope="module")
def logs(spark):
    return T.odl(spark, SF_SMALL), T.dcl(spark, SF_SMALL)


@pytest.fixture
def sorted_joins(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("job", [daily.base_daily, daily.time_table, quality.orphans, quality.accepted])
def test_same_rows_without_an_exchange(logs, sorted_joins, job):
    odl, dcl = bucketed_logs(*logs, buckets=5)
    got, want = job(odl, dcl), job(*logs)
    assert "Exchange" in plan(want) and "Exchange" not in plan(got)
    assert got.count() == want.count()
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_other_bucket_counts_and_days_without_lines(spark, logs, sorted_joins):
    odl, dcl = logs
    few = bucketed(odl.where("store_id <> 'view'"), "some-lines", 3)
    days = bucketed(dcl, "all-days", 3)
    left = days.join(daily.day_totals(few), "day_id", "left")
    assert "Exchange" not in plan(left)
    assert left.where("cnt IS NULL").count() == dcl.where("store_id = 'view'").count() > 0
    other = daily.base_daily(few, bucketed(dcl, "all-days", 4))  # unequal counts: one side moves, the rows stay right
    assert other.count() == dcl.where("store_id <> 'view'").count()


def test_null_days_and_empty_tables(spark, sorted_joins):
    odl = bucketed(spark.createDataFrame([(None, 1.0), ("a", 2.0), (None, 3.0)], "day_id string, v double"), "null-days", 4)
    none = bucketed(spark.createDataFrame([], "day_id string, w int"), "no-days", 4)
    assert sorted(r["v"] for r in odl.collect()) == [1.0, 2.0, 3.0]
    assert {r["day_id"]: r["n"] for r in odl.groupBy("day_id").agg({"v": "count"}).toDF("day_id", "n").collect()} == {None: 2, "a": 1}
    assert quality.orphans(odl, none).count() == 3 and quality.accepted(odl, none).count() == 0
