"""Typed CSV sources for the two logs, snapshots and sinks.

CSV dialect of the operational exports: UTF-8, ``,`` separator, optional
``"`` quoting, ``\\N`` for NULL, one header row, columns by position. Types are declared (no
inference); malformed lines (kept with their raw text) and rows missing a
NOT NULL column go to a quarantine frame instead of failing the load.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


TS_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"  # the fraction may be missing

ORDER_LINES_SCHEMA = T.StructType([
    T.StructField("day_id", T.StringType(), False),
    T.StructField("store_id", T.StringType(), True),
    T.StructField("order_id", T.LongType(), False),
    T.StructField("receipt_id", T.StringType(), True),
    T.StructField("order_datetime", T.TimestampNTZType(), True),
    T.StructField("order_date", T.DateType(), True),
    T.StructField("qty", T.IntegerType(), True),
    T.StructField("amount_g", T.DoubleType(), True),
])
ORDER_LINES_REQUIRED = ["day_id", "order_id"]

DAILY_LOG_SCHEMA = T.StructType([
    T.StructField("day_id", T.StringType(), False),
    T.StructField("store_id", T.StringType(), True),
    T.StructField("date", T.DateType(), False),
    T.StructField("day_of_week", T.StringType(), True),
    T.StructField("is_rain", T.IntegerType(), True),
    T.StructField("is_holiday", T.IntegerType(), True),
    T.StructField("long_weekend", T.StringType(), True),
    T.StructField("long_weekend_note", T.StringType(), True),
    T.StructField("is_pre_holiday", T.IntegerType(), True),
    T.StructField("special_day", T.StringType(), True),
    T.StructField("is_substitute", T.IntegerType(), True),
    T.StructField("first_raw_kg", T.DoubleType(), True),
    T.StructField("first_fried_kg", T.DoubleType(), True),
    T.StructField("is_refried", T.IntegerType(), True),
    T.StructField("pre_refry_left_g", T.DoubleType(), True),
    T.StructField("refry_time", T.StringType(), True),    # TIME as 'HH:mm:ss'
    T.StructField("second_raw_kg", T.DoubleType(), True),
    T.StructField("second_fried_kg", T.DoubleType(), True),
    T.StructField("end_g", T.DoubleType(), True),
    T.StructField("close_time", T.StringType(), True),    # TIME as 'HH:mm:ss'
    T.StructField("remark", T.StringType(), True),
    T.StructField("plus_kg", T.DoubleType(), True),
])
DAILY_LOG_REQUIRED = ["day_id", "date"]

# The export files' own layouts, by position: order ids are text and start anew each day; the daily file knows no store.
ORDER_FILE_SCHEMA = T.StructType([
    T.StructField("day_id", T.StringType(), False),
    T.StructField("order_id", T.StringType(), False),
    T.StructField("receipt_id", T.StringType(), True),
    T.StructField("order_datetime", T.TimestampNTZType(), True),
    T.StructField("channel", T.StringType(), True),
    T.StructField("source_file", T.StringType(), True),
    T.StructField("menu_name", T.StringType(), True),
    T.StructField("size_category", T.StringType(), True),
    T.StructField("qty", T.IntegerType(), True),
    T.StructField("amount_g", T.DoubleType(), True),
])
DAILY_FILE_SCHEMA = T.StructType([f for f in DAILY_LOG_SCHEMA.fields if f.name != "store_id"])


def _csv_options() -> dict[str, str]:
    return {
        "header": "true", "sep": ",", "quote": '"', "escape": '"', "encoding": "UTF-8",
        "mode": "PERMISSIVE", "nullValue": "\\N", "timestampNTZFormat": TS_FORMAT, "dateFormat": "yyyy-MM-dd",
    }


CORRUPT = "_corrupt_record"


def read_csv(spark: SparkSession, path: str, schema: T.StructType, keep_corrupt: bool = False) -> DataFrame:
    """Typed CSV read. With ``keep_corrupt`` a malformed line keeps its raw text
    in ``_corrupt_record`` (its typed fields are NULL) instead of being dropped."""
    if not keep_corrupt:
        return spark.read.options(**_csv_options()).schema(schema).csv(path)
    full = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType(), True)])
    return spark.read.options(**_csv_options(), columnNameOfCorruptRecord=CORRUPT).schema(full).csv(path)


def _load(spark: SparkSession, path: str, schema: T.StructType, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined): quarantined rows are malformed lines or miss a NOT NULL column."""
    from pyspark.sql import functions as F

    raw = read_csv(spark, path, schema, keep_corrupt=True)
    # always true, but needs every column: Spark converts only the columns that a query asks for,
    # and a line is malformed whichever of its fields can't be read
    raw = raw.filter(F.xxhash64(*schema.names) % 2 > -2)
    bad = F.col(CORRUPT).isNotNull()
    for name in required:
        bad = bad | F.col(name).isNull()
    return raw.filter(~bad).drop(CORRUPT), raw.filter(bad)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**_csv_options()).csv(path)


def load_order_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) order lines from CSV."""
    return _load(spark, path, ORDER_LINES_SCHEMA, ORDER_LINES_REQUIRED)


def load_daily_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) daily log rows from CSV."""
    return _load(spark, path, DAILY_LOG_SCHEMA, DAILY_LOG_REQUIRED)


def load_order_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) lines of the ten-column order file."""
    return _load(spark, path, ORDER_FILE_SCHEMA, ORDER_LINES_REQUIRED)


def load_daily_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) rows of the 21-column daily file."""
    return _load(spark, path, DAILY_FILE_SCHEMA, DAILY_LOG_REQUIRED)


def as_order_lines(lines: DataFrame, store: str) -> DataFrame:
    """Lines of one store's order file in the shape that the operators read (``order_id`` stays text)."""
    from pyspark.sql import functions as F

    return lines.select("day_id", F.lit(store).alias("store_id"), "order_id", "receipt_id", "order_datetime", F.to_date("order_datetime").alias("order_date"), "qty", "amount_g")


def write_snapshot(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrite a Parquet snapshot (the reference's drop-and-recreate)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_model(coef: DataFrame, path: str) -> None:
    """Persist a coefficient table (group, model, term, coef, ...) as Parquet."""
    coef.write.mode("overwrite").partitionBy("model").parquet(path)


def load_model(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if model is None else df.filter(df["model"] == model)
