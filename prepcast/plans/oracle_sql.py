"""DuckDB SQL of every registered query, for the side-by-side correctness check.

Each statement starts from the driver's raw tables: the fixture CTE rebuilds
the two logs, later CTEs mirror the reference's SQL. Rounding goes through
DECIMAL(38,10) and division through NULLIF, exactly like the Spark side.
"""

from __future__ import annotations

from prepcast.functions.columns import BINS30, STAGE1_BINS, STAGE2_BINS
from prepcast.sources.fixtures import ORACLE_FIXTURE_CTE


def R(x: str, n: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,10)), {n}) AS DOUBLE)"


def D(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def q(name: str) -> str:
    return f'"{name}"'


BIN30_SQL = (
    "lpad(CAST(hour(order_datetime) AS VARCHAR), 2, '0') || ':' || "
    "lpad(CAST(CAST(floor(minute(order_datetime) / 30) * 30 AS INTEGER) AS VARCHAR), 2, '0')"
)
BIN60_SQL = "lpad(CAST(hour(order_datetime) AS VARCHAR), 2, '0') || ':00'"
DEC = "CAST(amount_g AS DECIMAL(18,2))"

_bins = ",\n        ".join(
    f"CAST(SUM(CASE WHEN hh_mm = '{b}' THEN {DEC} ELSE 0 END) AS DOUBLE) AS {q(b)}" for b in BINS30
)
JT = f"""
jt AS (
    SELECT day_id, store_id,
        {_bins},
        CAST(SUM({DEC}) AS DOUBLE) AS sum_g,
        CAST(SUM(qty) AS BIGINT) AS cnt
    FROM (SELECT *, {BIN30_SQL} AS hh_mm FROM odl) b
    GROUP BY day_id, store_id
)"""

DAYT = f"""
dayt AS (
    SELECT day_id, CAST(SUM({DEC}) AS DOUBLE) AS sum_g, CAST(SUM(qty) AS BIGINT) AS cnt
    FROM odl GROUP BY day_id
)"""

HOLIDAY = "CASE WHEN is_holiday = 1 OR is_pre_holiday = 1 THEN 1 ELSE 0 END"
BIN_COLS = ", ".join(f"jt.{q(b)}" for b in BINS30)

TT = f"""
tt AS (
    SELECT jt.day_id, jt.store_id, d.date, d.day_of_week,
           {HOLIDAY.replace('is_', 'd.is_')} AS before_rest, d.end_g,
           {BIN_COLS}, jt.sum_g, jt.cnt,
           jt.sum_g - COALESCE(d.plus_kg, 0) * 1000 AS act_g
    FROM jt JOIN dcl d ON d.day_id = jt.day_id
)"""

BASE = f"""
base_daily AS (
    SELECT jt.day_id, jt.store_id, d.date, d.day_of_week,
           {HOLIDAY.replace('is_', 'd.is_')} AS holiday_status,
           d.first_fried_kg, d.second_fried_kg,
           {R('d.first_fried_kg + d.second_fried_kg', 2)} AS total_fired_kg,
           d.plus_kg, d.end_g,
           {BIN_COLS}, jt.sum_g, jt.cnt,
           jt.sum_g - d.plus_kg * 1000 AS act_g
    FROM jt JOIN dcl d ON d.day_id = jt.day_id
)"""

_s1 = " + ".join(q(b) for b in STAGE1_BINS)
_s2 = " + ".join(q(b) for b in STAGE2_BINS)
G = "PARTITION BY store_id ORDER BY date"
W = "PARTITION BY store_id, day_of_week ORDER BY date"


def _roll(x: str, spec: str, n: int) -> str:
    f = f"({spec} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN COUNT({x}) OVER {f} < {n} THEN NULL ELSE {R(f'AVG({x}) OVER {f}', 2)} END"


def _ratio(x: str, spec: str) -> str:
    return R(D(f"LAG({x}) OVER ({spec})", f"LAG(sum_g) OVER ({spec})"), 2)


MF = f"""
mbase AS (
    SELECT day_id, store_id, date, day_of_week, before_rest, end_g, sum_g,
           ({_s1}) AS cumul_16_19, ({_s2}) AS cumul_20_22
    FROM tt WHERE day_of_week != '목'
),
mf AS (
    SELECT *,
        LAG(cumul_16_19) OVER ({G}) AS lag_prev_day_t1,
        LAG(cumul_16_19) OVER ({W}) AS lag_same_day_t1,
        LAG(cumul_20_22) OVER ({G}) AS lag_prev_day_t2,
        LAG(cumul_20_22) OVER ({W}) AS lag_same_day_t2,
        LAG(cumul_16_19, 2) OVER ({W}) AS lag_biweekly_t1,
        LAG(cumul_20_22, 2) OVER ({W}) AS lag_biweekly_t2,
        {_roll('cumul_16_19', G, 3)} AS roll_prev_3days_mean_t1,
        {_roll('cumul_16_19', W, 3)} AS roll_same_3days_mean_t1,
        {_roll('cumul_20_22', G, 3)} AS roll_prev_3days_mean_t2,
        {_roll('cumul_20_22', W, 3)} AS roll_same_3days_mean_t2,
        {_roll('cumul_16_19', G, 5)} AS roll_prev_5days_mean_t1,
        {_roll('cumul_20_22', G, 5)} AS roll_prev_5days_mean_t2,
        {_ratio('cumul_16_19', G)} AS lag_prev_t1_ratio,
        {_ratio('cumul_16_19', W)} AS lag_same_t1_ratio,
        {_ratio('cumul_20_22', G)} AS lag_prev_t2_ratio,
        {_ratio('cumul_20_22', W)} AS lag_same_t2_ratio,
        LAG(sum_g) OVER ({G}) AS prev_sum_g,
        LAG(sum_g) OVER ({W}) AS same_prev_sum_g
    FROM mbase
)"""


def with_ctes(*ctes: str) -> str:
    """WITH <fixture>, <ctes...>"""
    return "WITH " + ",".join([ORACLE_FIXTURE_CTE, *ctes])


def sql(ctes: tuple[str, ...], body: str) -> str:
    return with_ctes(*ctes) + "\n" + body


FEATURE_CTES = (JT, TT, MF)

H1 = """
h1 AS (
    SELECT d.store_id, d.day_id, d.date, d.day_of_week, d.is_pre_holiday, t.sum_g
    FROM dcl d JOIN dayt t ON d.day_id = t.day_id WHERE d.day_of_week != '목'
)"""

H3 = f"""
h3 AS (
    SELECT store_id, day_id, date, day_of_week, ({_s1}) AS cumul_16_19, ({_s2}) AS cumul_20_22 FROM tt
)"""


def T_P(t: str, nu: str) -> str:
    """Two-sided Student-t tail for integer df by the finite series in theta = atan(|t|/sqrt(nu))."""
    th = f"atan(abs({t}) / sqrt({nu}))"
    c, s = f"cos({th})", f"sin({th})"
    odd = (f"(2.0 / pi()) * ({th} + {s} * {c} * coalesce(list_sum(list_transform(range(0, ({nu} - 1) // 2), "
           f"lambda j: coalesce(list_product(list_transform(range(1, j + 1), lambda i: (2.0 * i) / (2.0 * i + 1.0))), 1.0)"
           f" * pow({c}, 2 * j))), 0.0))")
    even = (f"{s} * list_sum(list_transform(range(0, {nu} // 2), "
            f"lambda j: coalesce(list_product(list_transform(range(1, j + 1), lambda i: (2.0 * i - 1.0) / (2.0 * i))), 1.0)"
            f" * pow({c}, 2 * j)))")
    return f"(CASE WHEN {t} IS NULL OR {nu} IS NULL OR {nu} <= 0 THEN NULL WHEN {nu} % 2 = 1 THEN 1.0 - {odd} ELSE 1.0 - {even} END)"


def _dseries(m: str, ratio: str, x: str) -> str:
    """1 + sum_{j=1..m} c_j x^j, c_j = prod_{i<=j} ratio(i) (DuckDB list lambdas)."""
    return (f"coalesce(list_sum(list_transform(range(0, ({m}) + 1), lambda j: coalesce(list_product("
            f"list_transform(range(1, j + 1), lambda i: {ratio})), 1.0) * pow({x}, j))), 1.0)")


def F_P(f: str, d1: str, d2: str) -> str:
    """Upper F tail for integer df by finite series (either df even, or both odd)."""
    x = f"({d2} / ({d2} + {d1} * {f}))"
    even1 = f"(pow({x}, {d2} / 2.0) * {_dseries(f'{d1} // 2 - 1', f'({d2} / 2.0 + i - 1) / i', f'(1 - {x})')})"
    even2 = f"(1 - pow(1 - {x}, {d1} / 2.0) * {_dseries(f'{d2} // 2 - 1', f'({d1} / 2.0 + i - 1) / i', x)})"
    th = f"atan(sqrt({d1} * {f} / {d2}))"
    c2, s2 = f"pow(cos({th}), 2)", f"pow(sin({th}), 2)"
    a = (f"(CASE WHEN {d2} = 1 THEN (2.0 / pi()) * {th} ELSE (2.0 / pi()) * ({th} + sin({th}) * cos({th}) * "
         f"{_dseries(f'({d2} - 3) // 2', '(2.0 * i) / (2.0 * i + 1.0)', c2)}) END)")
    gratio = (f"((1.0 / sqrt(pi())) * coalesce(list_product(list_transform(range(1, ({d2} - 1) // 2 + 1), "
              f"lambda i: i / (i - 0.5))), 1.0))")
    beta = (f"((2.0 / sqrt(pi())) * {gratio} * sin({th}) * pow(cos({th}), {d2}) * "
            f"{_dseries(f'({d1} - 3) // 2', f'({d2} + 2.0 * i - 1) / (2.0 * i + 1.0)', s2)})")
    odd = f"(CASE WHEN {d1} = 1 THEN 1.0 - {a} ELSE 1.0 - {a} + {beta} END)"
    return (f"(CASE WHEN {f} IS NULL OR {d1} <= 0 OR {d2} <= 0 THEN NULL WHEN {f} <= 0 THEN 1.0 "
            f"WHEN {d1} % 2 = 0 THEN {even1} WHEN {d2} % 2 = 0 THEN {even2} ELSE {odd} END)")


def DECISION(p: str) -> str:
    return f"(CASE WHEN {p} IS NULL THEN NULL WHEN {p} < 0.05 THEN 'reject' ELSE 'keep' END)"
