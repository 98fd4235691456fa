"""Scale shape: the same operators with many stores (user_id as the store key).

Every per-store result must equal the same computation done for that store
alone, i.e. grouping never mixes stores and no step relies on a single group.
"""

import numpy as np
from pyspark.sql import functions as F

from prepcast.operators import daily, features, regression, stats
from prepcast.sources.fixtures import daily_log, order_lines

from tests.paths import SF_MID


def _frames(spark):
    odl = order_lines(spark, SF_MID, store_col="user_id")
    dcl = daily_log(spark, SF_MID, store_col="user_id")
    tt = daily.time_table(odl, dcl)
    return odl, dcl, tt, features.model_feature(tt)


def test_many_stores_features_match_single_store_runs(spark):
    odl, dcl, tt, mf = _frames(spark)
    assert mf.select("store_id").distinct().count() > 100
    stores = [r[0] for r in mf.groupBy("store_id").count().orderBy(F.desc("count"), "store_id").limit(3).collect()]
    for s in stores:
        alone = features.model_feature(tt.filter(F.col("store_id") == s), entity=[]).drop("store_id")
        grouped = mf.filter(F.col("store_id") == s).drop("store_id")
        assert alone.exceptAll(grouped.select(*alone.columns)).count() == 0


def test_many_stores_tests_and_ols_per_group(spark):
    odl, dcl, tt, mf = _frames(spark)
    h3 = features.stage_targets(tt)
    t = {r["store_id"]: r for r in stats.ttest_rel(h3, "cumul_16_19", "cumul_20_22", ["store_id"]).collect()}
    fit = regression.ols_summary(mf, ["lag_prev_day_t1"], "cumul_16_19", ["store_id"], with_p=False)
    coef = {(r["store_id"], r["term"]): r["coef"] for r in fit.collect()}
    pdf = h3.toPandas()
    mpdf = mf.select("store_id", "lag_prev_day_t1", "cumul_16_19").toPandas()
    for s in list(t)[:5]:
        d = pdf[pdf.store_id == s]
        diff = (d.cumul_16_19 - d.cumul_20_22).to_numpy()
        if len(diff) > 1 and diff.std(ddof=1) > 0:
            assert abs(t[s]["t"] - diff.mean() / (diff.std(ddof=1) / np.sqrt(len(diff)))) < 1e-4
        sub = mpdf[mpdf.store_id == s].dropna()
        if len(sub) > 2 and sub.lag_prev_day_t1.std() > 0:
            x = np.column_stack([np.ones(len(sub)), sub.lag_prev_day_t1])
            beta = np.linalg.lstsq(x, sub.cumul_16_19.to_numpy(), rcond=None)[0]
            assert abs(coef[(s, "lag_prev_day_t1")] - beta[1]) < 1e-3
