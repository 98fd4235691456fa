"""Grouped tests against direct numpy computations."""

import numpy as np
from pyspark.sql import functions as F
import pandas as pd
import pytest

from tests import dist_check as dist
from prepcast.operators import stats


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(11)
    rows = []
    for g in ("a", "b"):
        for i in range(24):
            lv = ["월", "화", "금"][i % 3]
            rows.append({"grp": g, "lv": lv, "flag": i % 2, "x": float(rng.normal(100 + 5 * (i % 3), 10)),
                         "y": float(rng.normal(95, 10))})
    pdf = pd.DataFrame(rows)
    return pdf, spark.createDataFrame(pdf)


def test_paired_t_and_cohens_d(sample):
    pdf, df = sample
    out = stats.ttest_rel(df, "x", "y", ["grp"], with_p=True).toPandas().set_index("grp")
    d = stats.cohens_d(df, "x", "y", ["grp"]).toPandas().set_index("grp")
    for g, sub in pdf.groupby("grp"):
        diff = sub["x"] - sub["y"]
        t = diff.mean() / (diff.std() / np.sqrt(len(diff)))
        assert abs(out.loc[g, "t"] - t) < 1e-5
        assert abs(out.loc[g, "p"] - dist.t_two_sided(t, len(diff) - 1)) < 1e-6
        assert abs(d.loc[g, "cohens_d"] - diff.mean() / diff.std()) < 1e-5


def test_pooled_t_squared_is_two_group_f(sample):
    pdf, df = sample
    t = stats.ttest_ind(df, "x", "flag", ["grp"]).toPandas().set_index("grp")
    f = stats.anova(df, "x", "flag", ["grp"], levels=None).toPandas().set_index("grp")
    for g in ("a", "b"):
        assert abs(t.loc[g, "t"] ** 2 - f.loc[g, "F"]) < 1e-3


def test_levene_median_centre(sample):
    pdf, df = sample
    out = stats.levene(df, "x", "lv", ["grp"]).toPandas().set_index("grp")
    for g, sub in pdf.groupby("grp"):
        z = sub.groupby("lv")["x"].transform(lambda s: (s - s.median()).abs())
        parts = [z[sub.lv == lv] for lv in ["월", "화", "금"]]
        n, k = len(z), 3
        ssb = sum(len(p) * (p.mean() - z.mean()) ** 2 for p in parts)
        ssw = sum(((p - p.mean()) ** 2).sum() for p in parts)
        w = (n - k) / (k - 1) * ssb / ssw
        assert abs(out.loc[g, "F"] - w) < 1e-5


def test_wilcoxon_ties_and_zeros(spark):
    pdf = pd.DataFrame({"grp": ["a"] * 8, "x": [1, 2, 3, 4, 5, 6, 7, 8.0], "y": [1, 1, 1, 6, 1, 9, 2, 3.0]})
    out = stats.wilcoxon(spark.createDataFrame(pdf), "x", "y", ["grp"], with_p=True).collect()[0]
    d = (pdf.x - pdf.y)
    d = d[d != 0]
    ranks = d.abs().rank()
    wp, wm = ranks[d > 0].sum(), ranks[d < 0].sum()
    assert out["n"] == len(d)
    assert abs(out["statistic"] - min(wp, wm)) < 1e-9
    assert out["exact"] is False  # ties -> normal approximation


def test_shapiro_out_of_range_groups_are_reported(spark):
    pdf = pd.DataFrame({"grp": ["a", "a", "b", "b", "b", "b"], "x": [1.0, 2.0, 1.0, 2.5, 2.0, 7.0]})
    out = {r["grp"]: r for r in stats.shapiro(spark.createDataFrame(pdf), "x", ["grp"]).collect()}
    assert out["a"]["W"] is None and out["a"]["reason"] == "n<3"
    assert 0 < out["b"]["W"] <= 1 and out["b"]["p"] is not None


def test_prefix_counts_exact_for_any_bucketing(spark):
    import random

    random.seed(5)
    rows = [("g%d" % (i % 3), float(random.randint(0, 400)), random.randint(1, 4)) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, v double, c int").groupBy("g", "v").agg(F.sum("c").alias("c"))
    pdf = df.toPandas()
    for buckets in (1, 7, 64):
        out = stats.prefix_counts(df, ["g"], "v", "c", buckets=buckets).toPandas()
        for _, r in out.iterrows():
            sub = pdf[(pdf.g == r["g"]) & (pdf.v < r["v"])]
            assert r["_before"] == sub["c"].sum()


def test_shapiro_w_matches_reference_weights(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g, n in (("a", 4), ("b", 5), ("c", 6), ("d", 11), ("e", 40), ("f", 300)):
        rows += [(g, float(v)) for v in rng.gamma(2.0, 3.0, n)]
    pdf = pd.DataFrame(rows, columns=["grp", "x"])
    out = {r["grp"]: r for r in stats.shapiro(spark.createDataFrame(pdf), "x", ["grp"]).collect()}
    for g, sub in pdf.groupby("grp"):
        x = np.sort(sub["x"].to_numpy())
        a = np.array(dist.shapiro_weights(len(x)))
        w = min(1.0, (a @ x) ** 2 / np.sum((x - x.mean()) ** 2))
        assert abs(out[g]["W"] - w) < 2e-6, (g, out[g]["W"], w)
        assert abs(out[g]["p"] - dist.shapiro_p(w, len(x))) < 1e-4


def test_wilcoxon_exact_p_matches_python(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(10, 3, 18)
    y = x - rng.normal(0.8, 2, 18)
    pdf = pd.DataFrame({"grp": "a", "x": x, "y": y})
    r = stats.wilcoxon(spark.createDataFrame(pdf), "x", "y", ["grp"], with_p=True).collect()[0]
    assert r["exact"] is True
    assert abs(r["p"] - dist.wilcoxon_exact_two_sided(r["statistic"], r["n"])) < 1e-6


def test_shapiro_has_no_upper_limit(spark):
    rng = np.random.default_rng(2)
    x = {"ties": np.arange(5001) % 97, "large": rng.normal(0, 1, 50_000), "ok": np.array([1.0, 2.0, 4.0, 8.0]), "two": np.array([1.0, 2.0])}
    pdf = pd.DataFrame([(g, float(v)) for g, xs in x.items() for v in xs], columns=["grp", "x"])
    out = {r["grp"]: r for r in stats.shapiro(spark.createDataFrame(pdf), "x", ["grp"]).collect()}
    for g in ("ties", "large", "ok"):
        s = np.sort(x[g]).astype(float)
        w = (np.array(dist.shapiro_weights(len(s))) @ s) ** 2 / np.sum((s - s.mean()) ** 2)
        assert abs(out[g]["W"] - min(1.0, w)) < 2e-6 and out[g]["p"] is not None and out[g]["n"] == len(s)
    assert out["two"]["W"] is None and out["two"]["reason"] == "n<3"


def test_wilcoxon_counts_zeros(spark):
    rows = [("z", float(d), 0.0) for d in (0, 1, 2, 3, 4, 6)] + [("none", 1.0, 1.0)] * 3 + [("plain", float(d), 0.0) for d in (1, 2, 3, 4, 6)]
    df = spark.createDataFrame(rows, "grp string, x double, y double")
    out = {r["grp"]: r for r in stats.wilcoxon(df, "x", "y", ["grp"], with_p=True).collect()}
    assert (out["z"]["n"], out["z"]["zeros"], out["z"]["exact"], out["z"]["decision"]) == (5, 1, False, "reject") and abs(out["z"]["p"] - 0.0431) < 1e-3
    assert (out["none"]["n"], out["none"]["zeros"], out["none"]["p"]) == (0, 3, None)
    assert out["plain"]["exact"] and abs(out["plain"]["p"] - 0.0625) < 1e-9
    assert not stats.wilcoxon(df, "x", "y", ["grp"], method="approx").filter("exact").count()


def test_st_wilcoxon_says_where_the_exact_null_holds(spark, monkeypatch):
    import duckdb

    from prepcast.plans import q_analysis as Q
    from prepcast.plans.catalog import ORACLE
    from prepcast.plans.oracle_sql import sql

    groups = {"plain": [1, -2, 3, 4], "ties": [1, 1, -2, 3], "zero": [0, 1, 2], "none": [0, 0], "long": range(1, 52)}
    rows = [(g, float(d), 0.0) for g, ds in groups.items() for d in ds]
    h3 = spark.createDataFrame(rows, "store_id string, cumul_16_19 double, cumul_20_22 double")
    monkeypatch.setattr(Q.T, "h3", lambda *_: h3)
    out = Q.st_wilcoxon(spark, "")
    assert {r["store_id"]: r["exact"] for r in out.collect()} == {"plain": True, "ties": False, "zero": False, "none": False, "long": False}
    body = Q._wilcoxon_body(False)
    assert body in ORACLE["st_wilcoxon"]
    con = duckdb.connect()
    con.execute("CREATE TABLE h3 (store_id VARCHAR, cumul_16_19 DOUBLE, cumul_20_22 DOUBLE)")
    con.executemany("INSERT INTO h3 VALUES (?, ?, ?)", rows)
    cur = con.execute(sql((Q._WIL,), body))
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(out.columns)
    assert sorted(tuple(r[c] for c in cols) for r in out.collect()) == sorted(cur.fetchall())


def test_single_series_form_equals_the_only_group(sample):
    pdf, df = sample
    one = df.filter("grp = 'a'")
    for run in (lambda d, g: stats.shapiro(d, "x", g), lambda d, g: stats.wilcoxon(d, "x", "y", g, with_p=True), lambda d, g: stats.levene(d, "x", "lv", g, with_p=True),
                lambda d, g: stats.anova(d, "x", "lv", g, with_p=True), lambda d, g: stats.ttest_ind(d, "x", "flag", g, with_p=True)):
        (a,), (b,) = run(one, []).collect(), run(one, ["grp"]).drop("grp").collect()
        assert a.asDict() == b.asDict()


def test_tails_at_large_df(spark):
    from prepcast.functions.tails import f_p_sql, t_p_sql

    def integral(f, d1, d2):  # upper tail by quadrature of the density of ln F
        import math
        u = np.linspace(math.log(f), math.log(f) + 1.0, 200_001)
        e = np.exp(u)
        log = (math.lgamma((d1 + d2) / 2) - math.lgamma(d1 / 2) - math.lgamma(d2 / 2) + d1 / 2 * math.log(d1 / d2) + d1 / 2 * u - (d1 + d2) / 2 * np.log1p(d1 * e / d2))
        return np.trapezoid(np.exp(log), u)

    df = spark.createDataFrame([(1.05, 2000, 4000), (1.05, 20000, 40000), (0.99, 300, 100000)], "f double, d1 long, d2 long")
    for r in df.selectExpr("*", f"{f_p_sql('f', 'd1', 'd2')} AS p").collect():
        assert abs(r["p"] - integral(r["f"], r["d1"], r["d2"])) < 1e-6
    t = spark.createDataFrame([(1.959963984540054, 4_000_000)], "t double, nu long").selectExpr(f"{t_p_sql('t', 'nu')} AS p").first()["p"]
    assert abs(t - 0.05) < 1e-6


def test_t_tail_series_matches_incomplete_beta(spark):
    from prepcast.functions.tails import t_p_sql

    rows = [(2.68, 22), (-1.3, 1), (0.5, 2), (3.2, 7), (0.0, 5), (12.5, 9), (0.7, 3), (1.5, 2001)]
    df = spark.createDataFrame(rows, "t double, nu long")
    for r in df.selectExpr("t", "nu", f"{t_p_sql('t', 'nu')} AS p").collect():
        assert abs(r["p"] - dist.t_two_sided(r["t"], float(r["nu"]))) < 1e-10


def test_paired_t_equals_one_sample_t_on_differences(sample):
    pdf, df = sample
    paired = {r["grp"]: r["t"] for r in stats.ttest_rel(df, "x", "y", ["grp"]).collect()}
    diff = df.withColumn("d", F.col("x") - F.col("y"))
    one = {r["grp"]: r["t"] for r in stats.ttest_1samp(diff, "d", 0.0, ["grp"]).collect()}
    assert paired == one


def test_f_tail_series_matches_incomplete_beta(spark):
    import itertools

    from prepcast.functions.tails import f_p_sql

    rows = [(float(f), d1, d2) for f, d1, d2 in itertools.product([0.2, 1.0, 7.138, 40.0], [1, 2, 3, 5], [1, 2, 3, 14, 15])]
    df = spark.createDataFrame(rows, "f double, d1 long, d2 long")
    for r in df.selectExpr("f", "d1", "d2", f"{f_p_sql('f', 'd1', 'd2')} AS p").collect():
        assert abs(r["p"] - dist.f_sf(r["f"], r["d1"], r["d2"])) < 1e-10


def test_rank_sums_equal_the_sums_over_single_ranks(spark):
    from statistics import NormalDist

    from prepcast.functions.order_stats import EDGE, rank_sums

    n = 60_000
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    ranges = [(1, n), (1, 1), (n, n), (1, 5_000), (2, 40_001), (EDGE, n - EDGE), (EDGE + 1, n - EDGE), (30_000, 30_000 + 2 * EDGE), (59_000, n), (29_000, 31_000), (10, 150), (n - 200, n - 3)]
    df = spark.createDataFrame([(a, b, n) for a, b in ranges], "lo long, hi long, n long")
    for r in rank_sums(df, "lo", "hi", "n").collect():
        part = m[r["lo"] - 1:r["hi"]]
        assert abs(r["_m1"] - part.sum()) < 1e-7 * (1 + np.abs(part).sum()) and abs(r["_m2"] - (part**2).sum()) < 1e-7 * (1 + (part**2).sum()), r


def test_shapiro_with_a_tie_of_fifty_million_rows(spark):
    """The tied value is one row; the result follows from the same sums over the ranks in numpy."""
    n, few = 50_000_000, 1_000
    df = spark.range(n, numPartitions=8).selectExpr("'a' AS grp", f"IF(id < {few}, id, 5000) * 1D AS x")
    (r,) = stats.shapiro(df, "x", ["grp"]).collect()
    from statistics import NormalDist

    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, few + 1)])
    x = np.arange(few, dtype=float)
    rest = -m.sum()  # all ranks sum to zero
    mean = (x.sum() + 5000.0 * (n - few)) / n
    ss = ((x - mean) ** 2).sum() + (5000.0 - mean) ** 2 * (n - few)
    ssm = float(spark.range(1).selectExpr("1L AS lo", f"{n}L AS hi", f"{n}L AS n").transform(lambda d: __import__("prepcast.functions.order_stats", fromlist=["x"]).rank_sums(d, "lo", "hi", "n")).first()["_m2"])
    assert abs(ssm / n - 1) < 1e-4
    approx = (m @ x + 5000.0 * rest) ** 2 / ssm / ss  # the corrections of the two extreme weights don't show at this n
    assert r["n"] == n and abs(r["W"] - approx) < 1e-4 and r["p"] == 0.0


def test_quantiles_of_large_and_tied_groups(spark):
    from prepcast.operators.describe import box_summary, describe, iqr_outliers
    from prepcast.operators.selection import quantiles

    rng = np.random.default_rng(8)
    x = {"normal": rng.normal(5, 2, 120_000), "ties": rng.integers(0, 7, 60_000).astype(float), "one": np.array([3.5]), "two": np.array([1.0, 2.0]), "same": np.full(5000, 7.0), "skew": np.exp(rng.normal(0, 6, 50_000))}
    pdf = pd.DataFrame({"grp": np.repeat(list(x), [len(v) for v in x.values()]), "x": np.concatenate(list(x.values()))})
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame([("ties", None), ("empty", None)], "grp string, x double")).repartition(7)
    probs = [0.0, 0.001, 0.25, 0.5, 0.9, 1.0]
    for accuracy in (100, 10_000):  # a coarse sketch gives wide brackets and the same quantiles
        got = {r["grp"]: r for r in quantiles(df, "x", ["grp"], probs, accuracy).collect()}
        assert set(got) == set(x)
        for g, v in x.items():
            assert got[g]["_n"] == len(v) and np.allclose(got[g]["_q"], np.quantile(v, probs), rtol=1e-12)
    (one,) = quantiles(df.filter("grp = 'normal'"), "x", [], [0.5]).collect()
    assert one["_q"][0] == pytest.approx(np.median(x["normal"]), rel=1e-12)
    s = {r["grp"]: r for r in describe(df, "x", ["grp"]).collect()}
    b = {r["grp"]: r for r in box_summary(df, "x", ["grp"]).collect()}
    for g, v in x.items():
        assert s[g]["p50"] == pytest.approx(np.median(v), abs=1e-6) and b[g]["q3"] == pytest.approx(np.quantile(v, 0.75), abs=1e-5, rel=1e-9)
    q1, q3 = np.quantile(x["normal"], [0.25, 0.75])
    far = ((x["normal"] < q1 - 1.5 * (q3 - q1)) | (x["normal"] > q3 + 1.5 * (q3 - q1))).sum()
    assert iqr_outliers(df.filter("grp = 'normal'"), "x", ["grp"]).count() == far == b["normal"]["n_outliers"]
