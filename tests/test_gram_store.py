"""Refreshed Gram tables give the fits of all rows, and only changed rows are read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prepcast.operators import gram_store
from prepcast.operators.regression import model_grams, ols_long
from prepcast.session import scratch_path
from prepcast.sources.publish import versions

MODELS, GROUPS = {"one": ["a"], "two": ["a", "b"], "none": []}, ["shop"]


def fits(grams):
    return {(r["shop"], r["model"], r["term"]): (r["n"], r["coef"], r["se"], r["r2"]) for r in ols_long(grams, GROUPS).collect()}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (400, 2)) + [1e6, -3]
    y = x @ [2.0, -1.0] + rng.normal(0, 0.3, 400)
    data = [(f"s{i % 3}" if i < 300 or i % 2 else "new", i // 4, float(p[0]), None if i % 17 == 0 else float(p[1]), float(v)) for i, (p, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "shop string, day int, a double, b double, y double").persist()


@pytest.mark.parametrize("times, digits", [(1, 1e-6), (3, 1e-2)])
def test_refresh_equals_a_new_table(spark, rows, times, digits):
    """Withdrawn values of 10 million residual spreads cost the residual sums all but two or three digits; ordinary ones none."""
    path = scratch_path(spark, "grams")
    wrong = F.col("day").between(10, 14)
    before = rows.where("day < 75").withColumn("y", F.when(wrong, F.col("y") * times + 7).otherwise(F.col("y")))
    gram_store.create(path, before, MODELS, "y", GROUPS)
    gram_store.refresh(path, before.where(wrong), rows.where(wrong | (F.col("day") >= 75)), MODELS, "y", GROUPS)
    got, want = fits(gram_store.stored(spark, path)), fits(model_grams(rows, MODELS, "y", GROUPS))
    assert got.keys() == want.keys() and any(k[0] == "new" for k in got) and len(versions(spark, path)) == 2
    for k, w in want.items():
        assert got[k][0] == w[0] and [v is None for v in got[k]] == [v is None for v in w]
        assert np.allclose([v or 0 for v in got[k]], [v or 0 for v in w], rtol=digits), (k, got[k], w)


def test_withdrawing_everything_and_nothing(spark, rows):
    path = scratch_path(spark, "grams")
    gram_store.create(path, rows, MODELS, "y", GROUPS)
    one, none = rows.where("shop = 's1'"), rows.limit(0)
    gram_store.refresh(path, one, none, MODELS, "y", GROUPS)
    assert {r["shop"] for r in gram_store.stored(spark, path).collect()} == {"s0", "s2", "new"}
    kept = fits(gram_store.stored(spark, path))
    gram_store.refresh(path, none, none, MODELS, "y", GROUPS)
    assert fits(gram_store.stored(spark, path)) == kept
    gram_store.refresh(path, none, one, MODELS, "y", GROUPS)
    assert fits(gram_store.stored(spark, path)).keys() == fits(model_grams(rows, MODELS, "y", GROUPS)).keys()
