"""Model feature table: two stage targets plus lag / rolling / ratio features.

Windows run on the *daily* table (one row per store-day), never on order
lines. ``G`` is the store's business-day series, ``W`` the same weekday
series. Both partition by the entity, so with many stores the windows spread
over the cluster; equal frame specs share one Window node. Without an entity the one
series is cut into blocks (``halo``).
Every rolling frame ends at 1 PRECEDING: the current day never feeds its own
features (no leakage).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prepcast.functions.columns import DUMMY_LEVELS, FRI, STAGE1_BINS, STAGE2_BINS, THU, TUE, div, rnd, stage_sum
from prepcast.operators.halo import look_back

ENTITY = ["store_id"]

FEATURE_COLUMNS = [
    "lag_prev_day_t1", "lag_same_day_t1", "lag_prev_day_t2", "lag_same_day_t2",
    "lag_biweekly_t1", "lag_biweekly_t2",
    "roll_prev_3days_mean_t1", "roll_same_3days_mean_t1",
    "roll_prev_3days_mean_t2", "roll_same_3days_mean_t2",
    "roll_prev_5days_mean_t1", "roll_prev_5days_mean_t2",
    "lag_prev_t1_ratio", "lag_same_t1_ratio", "lag_prev_t2_ratio", "lag_same_t2_ratio",
    "prev_sum_g", "same_prev_sum_g",
]


def windows(entity: list[str] | None = None):
    entity = ENTITY if entity is None else entity
    return Window.partitionBy(*entity).orderBy("date"), Window.partitionBy(*entity, "day_of_week").orderBy("date")


def rolling_mean(x: str, spec, n: int) -> Column:
    """ROUND(AVG(x), 2) over the previous n rows; NULL until n values exist."""
    f = spec.rowsBetween(-n, -1)
    return F.when(F.count(x).over(f) < n, F.lit(None).cast("double")).otherwise(rnd(F.avg(x).over(f), 2))


def lag_ratio(x: str, spec) -> Column:
    return rnd(div(F.lag(x).over(spec), F.lag("sum_g").over(spec)), 2)


def stage_targets(tt: DataFrame) -> DataFrame:
    """Stage 1 (16-19h) and stage 2 (20-22h) targets from the bin columns."""
    return tt.withColumns({
        "cumul_16_19": stage_sum(STAGE1_BINS),
        "cumul_20_22": stage_sum(STAGE2_BINS),
    })


def exclude_weekday(df: DataFrame, label: str = THU) -> DataFrame:
    """``day_of_week != label``; a NULL weekday is dropped as well (3-valued logic)."""
    return df.filter(F.col("day_of_week") != label)


def model_feature(tt: DataFrame, entity: list[str] | None = None) -> DataFrame:
    """The ``model_feature`` view over a ``time_table``-shaped frame. ``entity=[]``: one series, in blocks with a halo."""
    base = exclude_weekday(stage_targets(tt)).select(
        "day_id", *(ENTITY if entity is None else entity), "date", "day_of_week", "before_rest",
        "end_g", "sum_g", "cumul_16_19", "cumul_20_22",
    )
    if entity == []:
        return look_back(look_back(base, [], "date", 5, _series_features), ["day_of_week"], "date", 3, _weekday_features)
    g, w = windows(entity)
    return base.withColumns({**_series_features(g), **_weekday_features(w)})


def _series_features(g) -> dict[str, Column]:
    """Features over the previous business days: at most five rows back."""
    t1, t2 = "cumul_16_19", "cumul_20_22"
    return {
        "lag_prev_day_t1": F.lag(t1).over(g),
        "lag_prev_day_t2": F.lag(t2).over(g),
        "roll_prev_3days_mean_t1": rolling_mean(t1, g, 3),
        "roll_prev_3days_mean_t2": rolling_mean(t2, g, 3),
        "roll_prev_5days_mean_t1": rolling_mean(t1, g, 5),
        "roll_prev_5days_mean_t2": rolling_mean(t2, g, 5),
        "lag_prev_t1_ratio": lag_ratio(t1, g),
        "lag_prev_t2_ratio": lag_ratio(t2, g),
        "prev_sum_g": F.lag("sum_g").over(g),
    }


def _weekday_features(w) -> dict[str, Column]:
    """Features over the same weekday: at most three rows back."""
    t1, t2 = "cumul_16_19", "cumul_20_22"
    return {
        "lag_same_day_t1": F.lag(t1).over(w),
        "lag_same_day_t2": F.lag(t2).over(w),
        "lag_biweekly_t1": F.lag(t1, 2).over(w),
        "lag_biweekly_t2": F.lag(t2, 2).over(w),
        "roll_same_3days_mean_t1": rolling_mean(t1, w, 3),
        "roll_same_3days_mean_t2": rolling_mean(t2, w, 3),
        "lag_same_t1_ratio": lag_ratio(t1, w),
        "lag_same_t2_ratio": lag_ratio(t2, w),
        "same_prev_sum_g": F.lag("sum_g").over(w),
    }


def date_range_filter(df: DataFrame, start: str, end: str) -> DataFrame:
    """``start <= date < end`` (a range, so it can reach a Parquet scan)."""
    return df.filter((F.col("date") >= F.lit(start).cast("date")) & (F.col("date") < F.lit(end).cast("date")))


def month_filter(df: DataFrame, month: str) -> DataFrame:
    """The reference's ``date LIKE 'YYYY-MM%'`` as a half-open range."""
    start = F.to_date(F.lit(f"{month}-01"))
    return df.filter((F.col("date") >= start) & (F.col("date") < F.add_months(start, 1)))


def validation_set(mf: DataFrame, start: str, end: str) -> DataFrame:
    """Five columns of the held-out period, filtered *after* the windows."""
    return (
        date_range_filter(mf, start, end)
        .select("day_id", "store_id", "date", "day_of_week", "cumul_20_22", "roll_prev_3days_mean_t2")
        .orderBy("store_id", "date")
    )


# Names of the dummy columns for the non-baseline weekday levels (화 -> dow_tue, 금 -> dow_fri).
DUMMY_NAMES = {TUE: "dow_tue", FRI: "dow_fri"}


def with_dummies(df: DataFrame, col: str = "day_of_week", levels: list[str] | None = None) -> DataFrame:
    """Dummy coding with fixed levels, first level dropped; an unlisted or NULL level gives all zeros."""
    levels = levels or DUMMY_LEVELS
    return df.withColumns({
        DUMMY_NAMES.get(lv, f"{col}_{lv}"): F.when(F.col(col) == lv, 1).otherwise(0) for lv in levels[1:]
    })
