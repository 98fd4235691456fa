"""One long series in blocks, exact signed ranks with ties, and publishing that fails half-way."""

import itertools

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from prepcast.functions.columns import BINS30
from prepcast.operators import features, halo, stats
from prepcast.session import scratch_path
from prepcast.sources.publish import publish, published, replace_dates, versions


def series(spark, n=700):
    """A daily table of one shop with gaps, nulls and Thursdays."""
    rng = np.random.default_rng(6)
    df = spark.range(n).selectExpr("CAST(id AS STRING) AS day_id", "date_add(DATE'2020-01-01', CAST(id + (id div 9) * 4 AS INT)) AS date", "id")
    from prepcast.functions.columns import weekday_label

    bins = {b: F.when(F.xxhash64("id", F.lit(b)) % 11 != 0, F.pmod(F.xxhash64(F.lit(b), "id"), F.lit(900)).cast("double")) for b in BINS30}
    return df.withColumns({"day_of_week": weekday_label(F.col("date")), "before_rest": F.lit(0), "end_g": F.lit(1.0), "sum_g": F.pmod(F.xxhash64("id"), F.lit(5)).cast("double"), **bins}).drop("id")


def test_one_series_in_blocks_equals_one_window(spark, monkeypatch):
    tt = series(spark)
    monkeypatch.setattr(halo, "BLOCK", 16)
    monkeypatch.setattr(features, "look_back", lambda *a: halo.look_back(*a, block=16))
    blocks = features.model_feature(tt, entity=[])
    whole = features.model_feature(tt.withColumn("shop", F.lit("s")), entity=["shop"]).drop("shop").select(*blocks.columns)
    assert blocks.count() == whole.count() > 500
    assert blocks.exceptAll(whole).count() == 0
    plan = blocks._jdf.queryExecution().executedPlan().toString().splitlines()
    assert any("hashpartitioning(_block" in x for x in plan) and any("hashpartitioning(day_of_week" in x and "_block" in x for x in plan)
    for above, x in zip(plan, plan[1:]):  # only the totals of the buckets, a fixed number of rows, meet in one task
        assert "SinglePartition" not in x or "Sort [_bucket" in above


def test_halo_reaches_as_far_as_told(spark):
    df = spark.range(200).selectExpr("date_add(DATE'2020-01-01', CAST(id * 3 AS INT)) AS day", "id", "id % 2 AS side")
    far = lambda w: {"x": F.lag("id", 5).over(w)}
    for keys in ([], ["side"]):
        got = {r["id"]: r["x"] for r in halo.look_back(df, keys, "day", 5, far, block=7).collect()}
        want = {r["id"]: r["x"] for r in df.withColumns(far(Window.partitionBy(*keys, F.lit(0)).orderBy("day"))).collect()}
        assert got == want
    with pytest.raises(ValueError):
        halo.look_back(df, [], "day", 5, far, block=3)


def test_exact_p_with_ties_and_zeros(spark):
    rows = [("ties", float(d)) for d in (1, 1, -2, 3, 3, 3, -4, 5)] + [("zeros", float(d)) for d in (0, 0, 2, -2, 2, 7)] + [("plain", float(d)) for d in (1, 2, -3, 4, 5, 6, 7)]
    rows += [("same", 2.0)] * 9 + [("none", 0.0)] * 3 + [("large", float(d)) for d in range(-20, 60)]
    out = {r["grp"]: r for r in stats.wilcoxon(spark.createDataFrame([(g, d, 0.0) for g, d in rows], "grp string, x double, y double"), "x", "y", ["grp"], with_p=True, method="both").collect()}
    for g in ("ties", "zeros", "plain", "same"):
        d = np.array([x for k, x in rows if k == g and x])
        a = np.abs(d)
        ranks = np.array([(a < v).sum() + ((a == v).sum() + 1) / 2 for v in a])
        stat = min(ranks[d > 0].sum(), ranks[d < 0].sum())
        hits = sum(np.dot(s, ranks) <= stat for s in itertools.product((0, 1), repeat=len(d)))
        assert out[g]["p_exact"] == pytest.approx(min(1.0, 2 * hits / 2 ** len(d)), abs=1e-6) and out[g]["statistic"] == stat
        assert out[g]["p_approx"] is not None and out[g]["decision_exact"] in ("keep", "reject")
    assert out["none"]["p_exact"] is None and out["none"]["p_approx"] is None
    assert out["large"]["p_exact"] is None and out["large"]["p_approx"] is not None


def test_only_the_dates_of_a_result_are_rewritten(spark):
    path = scratch_path(spark, "dates")
    replace_dates(spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2), ("2024-01-03", 3)], "date string, v int"), path)
    files = lambda: {r[0] for r in spark.read.parquet(path).select(F.input_file_name()).distinct().collect()}
    before = files()
    replace_dates(spark.createDataFrame([("2024-01-02", 20), ("2024-01-04", 4)], "date string, v int"), path)
    assert {(str(r["date"]), r["v"]) for r in spark.read.parquet(path).collect()} == {("2024-01-01", 1), ("2024-01-02", 20), ("2024-01-03", 3), ("2024-01-04", 4)}
    assert len(before & files()) == 2  # the other dates' files are the same files


def test_a_failed_second_write_leaves_the_former_version(spark):
    path = scratch_path(spark, "pair")
    assert versions(spark, path) == []
    one = {"days": spark.createDataFrame([(1,)], "day int"), "lines": spark.createDataFrame([(1, 5)], "day int, g int")}
    first = publish(one, path)
    broken = spark.range(1).select(F.raise_error(F.lit("no")).cast("int").alias("day"), F.lit(1).alias("g"))
    with pytest.raises(Exception, match="no"):
        publish({"days": spark.createDataFrame([(1,), (2,)], "day int"), "lines": broken}, path)
    assert versions(spark, path) == [first]
    assert published(spark, path, "days").count() == 1 and published(spark, path, "lines").count() == 1
    second = publish({"days": spark.createDataFrame([(1,), (2,)], "day int"), "lines": one["lines"]}, path)
    assert versions(spark, path) == [first, second] and published(spark, path, "days").count() == 2


def test_the_order_files_own_layout(spark, tmp_path):
    from prepcast.operators.daily import day_totals
    from prepcast.sources import logs

    p = tmp_path / "orders.csv"
    p.write_text("a,b,c,d,e,f,g,h,i,j\n"  # one header row, whatever it says: columns by position
                 '1,ORD01,r1,2026-05-01 16:05:00,hall,"log, a.csv","set ""2"", large",S,2,150.5\n'
                 "1,ORD02,r1,2026-05-01 16:35:00,\\N,x.csv,single,M,1,\\N\n"
                 "2,ORD01,r2,2026-05-02 20:00:00,app,x.csv,single,M,1,100\n"
                 "\\N,ORD01,r2,2026-05-02 20:00:00,app,x.csv,single,M,1,100\n"
                 "2,ORD02,r2,2026-05-02 20:00:00,app,x.csv,single,M,one,100\n"
                 "2,ORD03,r2\n")
    ok, bad = logs.load_order_file(spark, str(p))
    rows = {(r["day_id"], r["order_id"]): r for r in ok.collect()}
    assert set(rows) == {("1", "ORD01"), ("1", "ORD02"), ("2", "ORD01")} and bad.count() == 3
    assert rows["1", "ORD01"]["menu_name"] == 'set "2", large' and rows["1", "ORD01"]["source_file"] == "log, a.csv"
    totals = {r["day_id"]: (r["sum_g"], r["cnt"]) for r in day_totals(logs.as_order_lines(ok, "s"), ["day_id"]).collect()}
    assert totals == {"1": (150.5, 3), "2": (100.0, 1)}
    assert len(logs.ORDER_FILE_SCHEMA) == 10 and len(logs.DAILY_FILE_SCHEMA) == 21
