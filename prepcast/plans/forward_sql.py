"""DuckDB text of LOOCV forward selection, by successive residuals instead of Gram matrices.

State after each step, per store and row: the residual of the target and of every
candidate given the chosen features, and the row's leverage h. Adding a candidate with
residual c changes the target's residual e and the leverage in closed form,

    e' = e - c * sum(e * c) / sum(c * c),    h' = h + c * c / sum(c * c),

and the held-out error is e' / (1 - h'). The steps are unrolled; inside one the running
best is folded over the candidates in list order.
"""

from __future__ import annotations

from prepcast.plans.oracle_sql import R

FLAT = 1e-12  # a residual this small beside the candidate's own spread adds nothing


def forward_ctes(source: str, target: str, candidates: list[str], base: list[str], max_features: int, margin: float) -> tuple[str, str, str]:
    """(CTEs, trace query, result query) over the complete cases of ``source`` per store_id and day_id."""
    cols = [*base, *candidates]
    full = " AND ".join(f"{c} IS NOT NULL" for c in [target, *cols])
    vars_ = [(target, -1), *[(c, i) for i, c in enumerate(cols)]]
    long = "\nUNION ALL\n".join(f"SELECT store_id, day_id, '{c}' AS var, {i} AS ord, CAST({c} AS DOUBLE) AS x FROM {source} WHERE {full}" for c, i in vars_)
    ctes = [f"""
fs_x AS MATERIALIZED ({long}),
fs_e0 AS MATERIALIZED (SELECT store_id, day_id, var, ord, x - AVG(x) OVER g AS e, SUM(x * x) OVER g AS size FROM fs_x WINDOW g AS (PARTITION BY store_id, var)),
fs_h0 AS MATERIALIZED (SELECT store_id, day_id, 1.0 / COUNT(*) OVER (PARTITION BY store_id) AS h FROM fs_x WHERE ord = -1)"""]

    def add(k: int, pick: str) -> str:
        """State k + 1 from state k and ``pick`` (store_id, var): the chosen candidate leaves every residual."""
        return f"""
fs_p{k} AS MATERIALIZED (SELECT e.store_id, e.day_id, e.e AS c, SUM(e.e * e.e) OVER (PARTITION BY e.store_id) AS cc, MAX(e.size) OVER (PARTITION BY e.store_id) AS size
         FROM fs_e{k} e JOIN {pick} p ON p.store_id = e.store_id AND p.var = e.var),
fs_b{k} AS MATERIALIZED (SELECT e.store_id, e.var, CASE WHEN MAX(p.cc) > {FLAT} * MAX(p.size) THEN SUM(e.e * p.c) / MAX(p.cc) ELSE 0 END AS b
         FROM fs_e{k} e JOIN fs_p{k} p ON p.store_id = e.store_id AND p.day_id = e.day_id GROUP BY 1, 2),
fs_e{k + 1} AS MATERIALIZED (SELECT e.store_id, e.day_id, e.var, e.ord, e.e - b.b * p.c AS e, e.size
         FROM fs_e{k} e JOIN fs_p{k} p ON p.store_id = e.store_id AND p.day_id = e.day_id JOIN fs_b{k} b ON b.store_id = e.store_id AND b.var = e.var),
fs_h{k + 1} AS MATERIALIZED (SELECT h.store_id, h.day_id, h.h + CASE WHEN p.cc > {FLAT} * p.size THEN p.c * p.c / p.cc ELSE 0 END AS h
         FROM fs_h{k} h JOIN fs_p{k} p ON p.store_id = h.store_id AND p.day_id = h.day_id)"""

    for k, name in enumerate(base):
        ctes.append(f"""
fs_base{k} AS (SELECT DISTINCT store_id, '{name}' AS var FROM fs_x)""")
        ctes.append(add(k, f"fs_base{k}"))
    k = len(base)
    ctes.append(f"""
fs_cur{k} AS MATERIALIZED (SELECT h.store_id, SQRT(AVG(POW(e.e / (1 - h.h), 2))) AS rmse, [{', '.join(f"'{b}'" for b in base)}]::VARCHAR[] AS sel, TRUE AS active
         FROM fs_h{k} h JOIN fs_e{k} e ON e.store_id = h.store_id AND e.day_id = h.day_id AND e.ord = -1 GROUP BY 1)""")
    first, steps = k, min(max_features - len(base), len(candidates))
    for k in range(first, first + steps):
        ctes.append(f"""
fs_live{k} AS MATERIALIZED (SELECT c.*, SUM(c.e * c.e) OVER g AS cc, SUM(c.e * y.e) OVER g AS cy, y.e AS y, h.h
         FROM fs_e{k} c JOIN fs_e{k} y ON y.store_id = c.store_id AND y.day_id = c.day_id AND y.ord = -1
         JOIN fs_h{k} h ON h.store_id = c.store_id AND h.day_id = c.day_id JOIN fs_cur{k} s ON s.store_id = c.store_id AND s.active
         WHERE c.ord >= {len(base)} AND NOT list_contains(s.sel, c.var) WINDOW g AS (PARTITION BY c.store_id, c.var)),
fs_score{k} AS MATERIALIZED (SELECT store_id, var, ord,
         SQRT(AVG(POW(CASE WHEN cc > {FLAT} * size THEN (y - e * cy / cc) / (1 - h - e * e / cc) ELSE y / (1 - h) END, 2))) AS rmse FROM fs_live{k} GROUP BY 1, 2, 3),
fs_fold{k} AS MATERIALIZED (SELECT s.store_id, list_reduce(list_prepend({{'var': CAST(NULL AS VARCHAR), 'rmse': MAX(s.rmse)}}, list({{'var': c.var, 'rmse': c.rmse}} ORDER BY c.ord)),
         lambda a, x: CASE WHEN x.rmse < a.rmse - {margin!r} THEN x ELSE a END) AS best FROM fs_cur{k} s JOIN fs_score{k} c ON c.store_id = s.store_id GROUP BY 1),
fs_pick{k} AS MATERIALIZED (SELECT store_id, best.var AS var, best.rmse AS rmse FROM fs_fold{k} WHERE best.var IS NOT NULL),
fs_cur{k + 1} AS MATERIALIZED (SELECT s.store_id, coalesce(p.rmse, s.rmse) AS rmse, CASE WHEN p.var IS NULL THEN s.sel ELSE list_append(s.sel, p.var) END AS sel, p.var IS NOT NULL AS active
         FROM fs_cur{k} s LEFT JOIN fs_pick{k} p ON p.store_id = s.store_id)""")
        ctes.append(add(k, f"fs_pick{k}"))
    parts = [f"SELECT store_id, 0 AS step, CAST(NULL AS VARCHAR) AS candidate, {R('rmse', 4)} AS rmse, TRUE AS chosen FROM fs_cur{first}"]
    parts += [f"SELECT c.store_id, {k - first + 1}, c.var, {R('c.rmse', 4)}, CASE WHEN p.var IS NULL THEN NULL ELSE c.var = p.var END FROM fs_score{k} c LEFT JOIN fs_pick{k} p ON p.store_id = c.store_id" for k in range(first, first + steps)]
    result = f"SELECT store_id, array_to_string(sel, ',') AS selected, {R('rmse', 4)} AS rmse FROM fs_cur{first + steps}"
    return ",".join(ctes), "\nUNION ALL\n".join(parts), result
