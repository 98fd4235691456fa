"""Moments of many columns at once by matrix products, merged over partitions.

A task turns its rows of a group into a value matrix and a mask of the values that are
there. With X about the batch's own column means (zero where masked) and the mask M,

    M'M   counts the rows where both columns are present,
    X'M   sums one column over the rows where the other is present,
    (X*X)'M and X'X do so for squares and products,

so all pairwise-complete moments of p columns take four p x p products a batch, not a row
per pair and observation. Moments of two batches merge by the update of
means and centred products (no sum of raw squares ever cancels). Each task sends one row
per group, and one merge per group follows: at most a row per group and
partition, each of a few p x p numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepcast.functions.columns import single_series

HELD = 2000  # groups a task holds before it sends them on


class Pairs:
    """Pairwise-complete moments: ``n``, ``mean`` of column i where j is present, centred ``xx`` likewise, ``xy``."""

    def __init__(self, p: int):
        self.shapes = {"n": (p, p), "mean": (p, p), "xx": (p, p), "xy": (p, p)}

    def of(self, x: np.ndarray, m: np.ndarray) -> dict[str, np.ndarray]:
        there = np.maximum(m.sum(0), 1)
        level = np.where(m, x, 0.0).sum(0) / there
        x, m = np.where(m, x - level, 0.0), m.astype(float)
        n = m.T @ m
        s = x.T @ m
        mean = s / np.maximum(n, 1)
        return {"n": n, "mean": mean + level[:, None], "xx": np.maximum((x * x).T @ m - s * mean, 0.0), "xy": x.T @ x - s * mean.T}

    def merge(self, a: dict, b: dict) -> dict[str, np.ndarray]:
        n = a["n"] + b["n"]
        w = a["n"] * b["n"] / np.maximum(n, 1)
        d = np.where((a["n"] > 0) & (b["n"] > 0), b["mean"] - a["mean"], 0.0)
        mean = (a["n"] * a["mean"] + b["n"] * b["mean"]) / np.maximum(n, 1)
        near = np.where(b["n"] <= a["n"], a["mean"] + d * b["n"] / np.maximum(n, 1), b["mean"] - d * a["n"] / np.maximum(n, 1))
        return {"n": n, "mean": np.where(w > 0, near, mean), "xx": a["xx"] + b["xx"] + w * d * d, "xy": a["xy"] + b["xy"] + w * d * d.T}


class Models:
    """Moments of column sets over their own complete cases: ``n`` per set, ``mean`` and centred products ``xy``, padded to one size."""

    def __init__(self, sets: list[list[int]]):
        self.sets, k = sets, max(map(len, sets))
        self.shapes = {"n": (len(sets),), "mean": (len(sets), k), "xy": (len(sets), k, k)}

    def of(self, x: np.ndarray, m: np.ndarray) -> dict[str, np.ndarray]:
        out = {c: np.zeros(s) for c, s in self.shapes.items()}
        for i, cols in enumerate(self.sets):
            z = x[:, cols][m[:, cols].all(1)]
            if len(z):
                mean = z.mean(0)
                out["n"][i], out["mean"][i, :len(cols)], out["xy"][i, :len(cols), :len(cols)] = len(z), mean, (z - mean).T @ (z - mean)
        return out

    def merge(self, a: dict, b: dict) -> dict[str, np.ndarray]:
        n = a["n"] + b["n"]
        w, total = a["n"] * b["n"] / np.maximum(n, 1), np.maximum(n, 1)[:, None]
        d = np.where(w[:, None] > 0, b["mean"] - a["mean"], 0.0)
        mean = np.where(w[:, None] > 0, np.where((b["n"] <= a["n"])[:, None], a["mean"] + d * b["n"][:, None] / total, b["mean"] - d * a["n"][:, None] / total), a["mean"] + b["mean"])
        return {"n": n, "mean": mean, "xy": a["xy"] + b["xy"] + w[:, None, None] * d[:, :, None] * d[:, None, :]}


def merged(df: DataFrame, cols: list[str], groups: list[str], kind: Pairs | Models, rows: Callable[[dict], dict[str, list]], result: str) -> DataFrame:
    """The merged moments of each group, turned into result rows by ``rows`` (moments -> columns of equal length)."""
    v = df.select(*groups, *[F.col(f"`{c}`").cast("double").alias(f"_v{i}") for i, c in enumerate(cols)])
    keys = [v.schema[g] for g in groups]
    sent = T.StructType([*keys, *[T.StructField(f"_{c}", T.BinaryType()) for c in kind.shapes]])

    def out(held: dict) -> pd.DataFrame:
        return pd.DataFrame([(*key, *[np.ascontiguousarray(m[c]).tobytes() for c in kind.shapes]) for key, m in held.items()], columns=sent.names)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, held = to_arrow_schema(sent), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            key = pa.Table.from_batches([batch.select(groups)]).to_pandas(date_as_object=True)
            codes = key.groupby(groups, sort=False, dropna=False).ngroup().to_numpy()
            names = batch.select(groups).to_pylist()
            x = np.stack([batch.column(f"_v{i}").fill_null(0.0).to_numpy(zero_copy_only=False) for i in range(len(cols))], 1)
            m = np.stack([batch.column(f"_v{i}").is_valid().to_numpy(zero_copy_only=False) for i in range(len(cols))], 1)
            order = np.argsort(codes, kind="stable")
            cuts = np.flatnonzero(np.diff(codes[order])) + 1
            for at in np.split(order, cuts):
                k = tuple(names[at[0]].values())
                new = kind.of(x[at], m[at])
                held[k] = kind.merge(held[k], new) if k in held else new
            if len(held) >= HELD:
                yield pa.RecordBatch.from_pandas(out(held), schema=arrow, preserve_index=False)
                held = {}
        if held:
            yield pa.RecordBatch.from_pandas(out(held), schema=arrow, preserve_index=False)

    final = T.StructType([*keys, *T._parse_datatype_string(result).fields])

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        total = None
        for r in table.select([f"_{c}" for c in kind.shapes]).to_pylist():
            one = {c: np.frombuffer(r[f"_{c}"], float).reshape(s) for c, s in kind.shapes.items()}
            total = one if total is None else kind.merge(total, one)
        found = rows(total)
        n = len(next(iter(found.values())))
        arrow = to_arrow_schema(final)
        held = {g: pa.array([k.as_py()] * n, arrow.field(g).type) for g, k in zip(groups, key)}
        return pa.table({**held, **{c: pa.array(x, arrow.field(c).type) for c, x in found.items()}}, schema=arrow)

    return v.mapInArrow(local, sent).groupBy(*groups).applyInArrow(merge, final)


@single_series
def pair_moments(df: DataFrame, cols: list[str], groups: list[str], with_: str | None = None) -> DataFrame:
    """(groups, x, y, n, sxx, syy, sxy) for every unordered pair of ``cols`` (``with_``: only pairs of that column as y), over the rows where both are present."""
    p = len(cols)
    pairs = [(i, cols.index(with_)) for i in range(p)] if with_ else [(i, j) for i in range(p) for j in range(i, p)]
    i, j = (np.array(x) for x in zip(*pairs))

    def rows(m: dict) -> dict[str, list]:
        return {"x": [cols[a] for a in i], "y": [cols[b] for b in j], "n": m["n"][i, j].astype(int).tolist(), "sxx": m["xx"][i, j].tolist(), "syy": m["xx"][j, i].tolist(), "sxy": m["xy"][i, j].tolist()}

    return merged(df, cols, groups, Pairs(p), rows, "x string, y string, n long, sxx double, syy double, sxy double")


@single_series
def model_moments(df: DataFrame, models: dict[str, list[str]], target: str, groups: list[str]) -> DataFrame:
    """The rows of ``regression.model_grams`` in one pass: ``shift`` is the mean of each model's own complete cases."""
    cols = list(dict.fromkeys([c for x in models.values() for c in x] + [target]))
    place = {c: i for i, c in enumerate(cols)}
    sets = [[place[c] for c in [*x, target]] for x in models.values()]

    def rows(m: dict) -> dict[str, list]:
        grams, shifts = [], []
        for s, n, mean, xy in zip(sets, m["n"], m["mean"], m["xy"]):
            k = len(s)
            full = np.zeros((k + 1, k + 1))
            full[0, 0], full[1:, 1:] = n, xy[:k, :k]
            grams.append(full[np.triu_indices(k + 1)].tolist())
            shifts.append(mean[:k].tolist())
        return {"model": list(models), "terms": list(models.values()), "n": m["n"].astype(int).tolist(), "gram": grams, "shift": shifts}

    return merged(df, cols, groups, Models(sets), rows, "model string, terms array<string>, n long, gram array<double>, shift array<double>")
