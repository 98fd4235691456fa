"""Scalar column builders shared by every operator (all JVM-side expressions)."""

from __future__ import annotations

import functools
import inspect

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# Weekday labels, Monday first (the reference stores weekdays in Korean).
WEEKDAY_LABELS = ["월", "화", "수", "목", "금", "토", "일"]
MON, TUE, THU, FRI = "월", "화", "목", "금"
# Half-hour bins pivoted into daily columns, 16:00 to 22:30.
BINS30 = ["16:00", "16:30", "17:00", "17:30", "18:00", "18:30", "19:00",
          "19:30", "20:00", "20:30", "21:00", "21:30", "22:00", "22:30"]
# Stage 1 target (16-19h) and stage 2 target (20-22h) bin groups.
STAGE1_BINS = ["16:00", "16:30", "17:00", "17:30", "18:00", "18:30", "19:00", "19:30"]
STAGE2_BINS = ["20:00", "20:30", "21:00", "21:30", "22:00", "22:30"]
# Dummy coding of the weekday: levels in order, first level is the baseline.
DUMMY_LEVELS = ["월", "화", "금"]
# ---------------------------------------------------------------------------


def c(name: str) -> Column:
    """Column by name, quoting names such as ``16:00``."""
    return F.col(f"`{name}`")


def weekday_label(date_col: Column) -> Column:
    """Weekday label of a date (``weekday`` is 0 for Monday)."""
    return F.element_at(F.array(*[F.lit(x) for x in WEEKDAY_LABELS]), F.weekday(date_col) + 1)


def bin30(ts: Column) -> Column:
    """'HH:00' / 'HH:30' label of a timestamp."""
    half = (F.floor(F.minute(ts) / 30) * 30).cast("int").cast("string")
    return F.concat(F.lpad(F.hour(ts).cast("string"), 2, "0"), F.lit(":"), F.lpad(half, 2, "0"))


def bin30_index(ts: Column) -> Column:
    """Half-hour slot of the day, 0..47 (integer key for the hot path; label it after aggregating)."""
    return (F.hour(ts) * 2 + F.when(F.minute(ts) >= 30, 1).otherwise(0)).cast("int")


def bin30_label(idx: Column) -> Column:
    """'HH:00' / 'HH:30' label of a half-hour slot index."""
    return F.concat(F.lpad((idx / 2).cast("int").cast("string"), 2, "0"), F.lit(":"),
                    F.when(idx % 2 == 1, F.lit("30")).otherwise(F.lit("00")))


def bin30_slot(label: str) -> int:
    """Slot index of a fixed 'HH:MM' label."""
    hh, mm = label.split(":")
    return int(hh) * 2 + (1 if mm == "30" else 0)


def bin60(ts: Column) -> Column:
    """'HH:00' label of a timestamp."""
    return F.concat(F.lpad(F.hour(ts).cast("string"), 2, "0"), F.lit(":00"))


def bin60_label(hour: Column) -> Column:
    return F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":00"))


def holiday_flag(holiday: Column, pre_holiday: Column) -> Column:
    """1 when either flag is 1, else 0 (NULL flags count as 0)."""
    return F.when((holiday == 1) | (pre_holiday == 1), F.lit(1)).otherwise(F.lit(0))


def rnd(x: Column, scale: int) -> Column:
    """ROUND half-up on the decimal value, returned as double.

    Rounding through decimal(38,10) gives the same digits in Spark and in
    DuckDB, where plain double rounding can differ at the last place.
    """
    return F.round(x.cast("decimal(38,10)"), scale).cast("double")


def rnd_even(x: Column, scale: int = 0) -> Column:
    """Round half to even (Python/numpy ``round``)."""
    return F.bround(x.cast("decimal(38,10)"), scale).cast("double")


def div(a: Column, b: Column) -> Column:
    """a / b with NULL on a zero divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


UNITS = 1_000_000


def units(x: Column) -> Column:
    """An amount as integer millionths: finer than the FLOAT source column resolves, and sums exactly in any order."""
    return F.round(x * UNITS).cast("long")


def from_units(c: Column) -> Column:
    """Integer millionths back to the amount, as the nearest double."""
    return c.cast("double") / F.lit(float(UNITS))


def g_to_kg(sum_g: Column) -> Column:
    return rnd(div(sum_g, F.lit(1000.0)), 2)


def stage_sum(bins: list[str]) -> Column:
    out = c(bins[0])
    for b in bins[1:]:
        out = out + c(b)
    return out


SERIES = "_series"


def join_groups(a: DataFrame, b: DataFrame, groups: list[str]) -> DataFrame:
    """Inner join on the entity columns; without any, ``b`` (a keyless aggregate: one row) joins on a literal key."""
    if groups:
        return a.join(b, groups, "inner")
    key = {SERIES: F.lit(0)}
    return a.withColumns(key).join(F.broadcast(b.withColumns(key)), SERIES).drop(SERIES)


def single_series(fn):
    """Let a grouped function take ``groups=[]``: all rows get one literal key, which the result doesn't show."""
    sig = inspect.signature(fn)

    @functools.wraps(fn)
    def run(*args, **kwargs):
        call = sig.bind(*args, **kwargs)
        if call.arguments.get("groups") != []:
            return fn(*args, **kwargs)
        first = next(iter(call.arguments))
        call.arguments[first] = call.arguments[first].withColumn(SERIES, F.lit(0))
        call.arguments["groups"] = [SERIES]
        out = fn(*call.args, **call.kwargs)
        return tuple(d.drop(SERIES) for d in out) if isinstance(out, tuple) else out.drop(SERIES)

    return run
