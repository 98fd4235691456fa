"""Sources, sinks and the streaming bin table."""

import os
import tempfile

import pytest

from pyspark.sql import functions as F

from prepcast.plans import tables as T
from prepcast.sources import logs
from prepcast.streaming import bins_stream

from tests.paths import SF_SMALL


def test_csv_quarantine_and_types(spark):
    d = tempfile.mkdtemp(prefix="prepcast-csv-", dir="/tmp")
    path = os.path.join(d, "lines.csv")
    with open(path, "w", encoding="utf-8") as fh:
        fh.write("day_id,store_id,order_id,receipt_id,order_datetime,order_date,qty,amount_g\n")
        fh.write('s_2024-01-01,s,1,"r,1",2024-01-01 16:05:00.000000,2024-01-01,2,150.5\n')
        fh.write(",s,2,r2,2024-01-01 16:10:00.000000,2024-01-01,1,10\n")          # missing key -> quarantine
        fh.write("s_2024-01-01,s,3,r3,2024-01-01 17:00:00.000000,2024-01-01,x,20\n")  # bad int -> quarantine
    ok, bad = logs.load_order_lines(spark, d)
    rows = {r["order_id"]: r for r in ok.collect()}
    assert set(rows) == {1}
    assert rows[1]["receipt_id"] == "r,1" and rows[1]["amount_g"] == 150.5 and rows[1]["qty"] == 2
    quarantined = {r["order_id"]: r for r in bad.collect()}
    assert set(quarantined) == {2, 3}                       # missing key; malformed number
    assert quarantined[3]["_corrupt_record"].startswith("s_2024-01-01,s,3,")
    assert "_corrupt_record" not in ok.columns
    assert dict(ok.dtypes)["order_datetime"] == "timestamp_ntz"


def test_csv_round_trip_keeps_microseconds(spark):
    from prepcast.session import scratch_path

    odl = T.odl(spark, SF_SMALL)
    path = scratch_path(spark, "rt")
    logs.write_csv(odl, path)
    back, bad = logs.load_order_lines(spark, path)
    assert bad.count() == 0
    assert back.exceptAll(odl.select(*back.columns)).count() == 0


def test_stream_matches_batch_bins(spark):
    got = bins_stream.run_available(spark, SF_SMALL, file_glob="events.parquet")
    lines = T.odl(spark, SF_SMALL)
    want = lines.groupBy("store_id", F.window(F.col("order_datetime").cast("timestamp"), "30 minutes")).agg(
        F.sum(F.col("amount_g").cast("decimal(18,2)")).cast("double").alias("amount_g"), F.count(F.lit(1)).alias("n_lines")
    ).select("store_id", F.col("window.start").cast("timestamp_ntz").alias("bin_start"), "amount_g", "n_lines")
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0


def test_model_round_trip(spark):
    from prepcast.operators import regression
    from prepcast.session import scratch_path

    af = T.mf(spark, SF_SMALL).withColumn("dow_fri", (F.col("day_of_week") == "금").cast("int"))
    coef, _ = regression.ols_tables(
        regression.model_grams(af, {"t2": ["dow_fri", "roll_prev_3days_mean_t2"]}, "cumul_20_22", ["store_id"]),
        ["store_id"])
    path = scratch_path(spark, "model")
    logs.save_model(coef, path)
    back = logs.load_model(spark, path, "t2")
    assert back.select("store_id", "term", "coef").exceptAll(coef.select("store_id", "term", "coef")).count() == 0


def test_stream_incremental_upsert_matches_batch(spark):
    """Two arrival batches (split inside one day, so some bins get updated by the
    second batch) processed by two AvailableNow runs on one checkpoint."""
    from prepcast.session import scratch_path

    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    land = tempfile.mkdtemp(prefix="prepcast-land-", dir="/tmp")
    cut = F.lit("2024-01-15 18:10:00").cast("timestamp_ntz")
    ev.filter(F.col("ts") < cut).coalesce(1).write.parquet(f"{land}/part1")
    sink, ckpt = scratch_path(spark, "sink"), scratch_path(spark, "ckpt")
    src = tempfile.mkdtemp(prefix="prepcast-src-", dir="/tmp")
    import shutil

    shutil.copy(next(p for p in _files(f"{land}/part1")), f"{src}/a.parquet")
    first = bins_stream.run_available(spark, src, sink=sink, checkpoint=ckpt).count()
    ev.filter(F.col("ts") >= cut).coalesce(1).write.parquet(f"{land}/part2")
    shutil.copy(next(p for p in _files(f"{land}/part2")), f"{src}/b.parquet")
    got = bins_stream.run_available(spark, src, sink=sink, checkpoint=ckpt)
    want = bins_stream.run_available(spark, SF_SMALL, file_glob="events.parquet")
    assert first < got.count()
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0


def _files(folder):
    return [os.path.join(folder, f) for f in sorted(os.listdir(folder)) if f.endswith(".parquet")]


def test_stream_counts_lines_that_arrive_late(spark):
    from prepcast.session import scratch_path
    import shutil

    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    land = tempfile.mkdtemp(prefix="prepcast-land-", dir="/tmp")
    src = tempfile.mkdtemp(prefix="prepcast-src-", dir="/tmp")
    recent = F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")
    old = F.col("ts") < F.lit("2024-01-05").cast("timestamp_ntz")
    ev.filter(recent).coalesce(1).write.parquet(f"{land}/recent")
    ev.filter(old).coalesce(1).write.parquet(f"{land}/old")
    sink, ckpt = scratch_path(spark, "sink"), scratch_path(spark, "ckpt")
    shutil.copy(_files(f"{land}/recent")[0], f"{src}/a.parquet")
    first = bins_stream.run_available(spark, src, sink=sink, checkpoint=ckpt)
    n_recent = first.count()
    shutil.copy(_files(f"{land}/old")[0], f"{src}/b.parquet")     # older than all that came before
    after = bins_stream.run_available(spark, src, sink=sink, checkpoint=ckpt)
    assert after.count() > n_recent
    want = bins_stream.half_hour_sums(bins_stream.order_line_stream(spark, src).sparkSession.read.parquet(src).selectExpr("event_type store_id", "ts order_datetime", "value amount_g"))
    assert sorted((r.store_id, r.bin_start, r.n_lines) for r in after.collect()) == sorted((r.store_id, r.bin_start, r.n_lines) for r in want.collect())
    into = scratch_path(spark, "compacted")
    bins_stream.compact(spark, sink, into)
    assert bins_stream.read_bins(spark, into).exceptAll(after).count() == 0


def test_null_marker_and_times_without_fraction(spark, tmp_path):
    p = tmp_path / "lines.csv"
    p.write_text("day_id,store_id,order_id,receipt_id,order_datetime,order_date,qty,amount_g\n"
                 "s_2024-01-01,s,1,\\N,2024-01-01 16:05:09,2024-01-01,\\N,10.125\n"
                 "s_2024-01-01,\\N,2,r2,2024-01-01 16:05:09.250000,2024-01-01,3,\n"
                 "s_2024-01-01,s,x,r3,2024-01-01 16:05:09,2024-01-01,3,1.5\n"
                 "\\N,s,4,r4,2024-01-01 16:05:09,2024-01-01,3,1.5\n")
    ok, bad = logs.load_order_lines(spark, str(p))
    rows = {r["order_id"]: r for r in ok.collect()}
    assert set(rows) == {1, 2} and bad.count() == 2
    assert rows[1]["receipt_id"] is None and rows[1]["qty"] is None and rows[1]["amount_g"] == 10.125
    assert rows[1]["order_datetime"].microsecond == 0 and rows[2]["order_datetime"].microsecond == 250000
    assert rows[2]["store_id"] is None and rows[2]["amount_g"] is None


def test_a_cluster_must_name_its_shared_folder():
    from prepcast.session import require_local

    require_local("local[8]")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            require_local(master)


def test_amounts_keep_their_third_decimal(spark):
    from prepcast.functions.columns import from_units, units

    df = spark.range(1000).selectExpr("0.001D as g")
    assert df.agg(from_units(F.sum(units(F.col("g")))).alias("g")).first()["g"] == 1.0
