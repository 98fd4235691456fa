"""Hypothesis tests as grouped Spark aggregates.

Every test returns one row per group (``groups``, e.g. the store): sample
sizes, the statistic and its degrees of freedom. Only those sufficient
statistics leave the aggregation. The p-value (``with_p=True``) is a JVM
expression (exact finite series for the t and F tails, the exact signed-rank
null, Royston's transform with a double-precision normal tail), so no test
needs Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prepcast.functions.columns import DUMMY_LEVELS, div, rnd, single_series
from prepcast.operators.selection import quantiles

DIGITS = 6  # emitted statistics are rounded to this many decimals
ALPHA = 0.05


def _r(x: Column) -> Column:
    return rnd(x, DIGITS)


def decision(p: Column, alpha: float = ALPHA, yes: str = "reject", no: str = "keep") -> Column:
    """``reject`` when p < alpha, else ``keep`` (NULL p -> NULL)."""
    return F.when(p.isNull(), F.lit(None).cast("string")).when(p < alpha, F.lit(yes)).otherwise(F.lit(no))


def ttest_1samp(df: DataFrame, value: str, popmean: float, groups: list[str], with_p: bool = False) -> DataFrame:
    """One-sample t of mean(value) against ``popmean``."""
    a = df.filter(F.col(value).isNotNull()).groupBy(*groups).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")
    )
    t = div(F.col("mean") - F.lit(float(popmean)), F.col("sd") / F.sqrt("n"))
    out = a.select(*groups, "n", _r(F.col("mean")).alias("mean"), _r(F.col("sd")).alias("sd"),
                   t.alias("_t"), (F.col("n") - 1).alias("df"))
    return _finish_t(out, with_p)


def _finish_t(out: DataFrame, with_p: bool) -> DataFrame:
    """Round the statistic ``_t`` into ``t``; with_p adds p (from the unrounded t) and the decision."""
    if with_p:
        from prepcast.functions.tails import t_p_sql

        out = out.withColumn("p", _r(F.expr(t_p_sql("_t", "df"))))
        out = out.withColumn("decision", decision(F.col("p")))
    return out.withColumn("t", _r(F.col("_t"))).drop("_t")


def _finish_f(out: DataFrame, with_p: bool) -> DataFrame:
    """Round ``_F`` into ``F``; with_p adds p (from the unrounded F) and the decision."""
    if with_p:
        from prepcast.functions.tails import f_p_sql

        out = out.withColumn("p", _r(F.expr(f_p_sql("_F", "df1", "df2"))))
        out = out.withColumn("decision", decision(F.col("p")))
    return out.withColumn("F", _r(F.col("_F"))).drop("_F")


def ttest_rel(df: DataFrame, x: str, y: str, groups: list[str], with_p: bool = False) -> DataFrame:
    """Paired t on x - y (pairs with both values)."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_d", F.col(x) - F.col(y))
    a = d.groupBy(*groups).agg(F.count("_d").alias("n"), F.avg("_d").alias("mean_diff"), F.stddev_samp("_d").alias("sd_diff"))
    t = div(F.col("mean_diff"), F.col("sd_diff") / F.sqrt("n"))
    out = a.select(*groups, "n", _r(F.col("mean_diff")).alias("mean_diff"), _r(F.col("sd_diff")).alias("sd_diff"),
                   t.alias("_t"), (F.col("n") - 1).alias("df"))
    return _finish_t(out, with_p)


def cohens_d(df: DataFrame, x: str, y: str, groups: list[str]) -> DataFrame:
    """mean(x - y) / sample sd(x - y)."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_d", F.col(x) - F.col(y))
    a = d.groupBy(*groups).agg(F.count("_d").alias("n"), F.avg("_d").alias("m"), F.stddev_samp("_d").alias("s"))
    return a.select(*groups, "n", _r(div(F.col("m"), F.col("s"))).alias("cohens_d"))


def ttest_ind(df: DataFrame, value: str, label: str, groups: list[str], a_level=0, b_level=1,
              with_p: bool = False) -> DataFrame:
    """Pooled-variance two-sample t (equal_var=True), level a minus level b."""
    v = df.filter(F.col(value).isNotNull() & F.col(label).isin(a_level, b_level))
    s = v.groupBy(*groups).agg(*[
        expr for lv, tag in ((a_level, "a"), (b_level, "b"))
        for expr in (
            F.count(F.when(F.col(label) == lv, F.col(value))).alias(f"n_{tag}"),
            F.avg(F.when(F.col(label) == lv, F.col(value))).alias(f"mean_{tag}"),
            F.var_samp(F.when(F.col(label) == lv, F.col(value))).alias(f"var_{tag}"),
        )
    ])
    dfree = F.col("n_a") + F.col("n_b") - 2
    sp2 = div((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b"), dfree)
    t = div(F.col("mean_a") - F.col("mean_b"), F.sqrt(sp2 * (F.lit(1.0) / F.col("n_a") + F.lit(1.0) / F.col("n_b"))))
    out = s.select(*groups, "n_a", "n_b", _r(F.col("mean_a")).alias("mean_a"), _r(F.col("mean_b")).alias("mean_b"),
                   t.alias("_t"), dfree.alias("df"))
    return _finish_t(out, with_p)


def _oneway(df: DataFrame, value: str, label: str, groups: list[str]) -> DataFrame:
    """F of a one-way layout from per-cell n / sum / mean / variance, in one pass over the rows.

    The grand mean is attached to the cells by a window over a group's cells (one row per
    label), so the sums of squares are about means and the rows are read once."""
    cell = df.groupBy(*groups, label).agg(
        F.count(value).alias("ni"), F.sum(value).alias("si"), F.avg(value).alias("mi"),
        F.var_pop(value).alias("vi"),
    ).filter(F.col("ni") > 0)
    whole = Window.partitionBy(*groups)
    cell = cell.withColumn("grand", F.sum("si").over(whole) / F.sum("ni").over(whole))
    tot = cell.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("k"), F.sum("ni").alias("N"), F.sum(F.col("ni") * F.col("vi")).alias("ssw"),
        F.sum(F.col("ni") * (F.col("mi") - F.col("grand")) ** 2).alias("ssb"),
    )
    d1, d2 = F.col("k") - 1, F.col("N") - F.col("k")
    fstat = div(F.col("ssb") / d1, F.col("ssw") / d2)
    return tot.select(*groups, "k", "N", fstat.alias("_F"), d1.alias("df1"), d2.alias("df2"))


@single_series
def anova(df: DataFrame, value: str, label: str, groups: list[str], levels: list | None = DUMMY_LEVELS,
          with_p: bool = False) -> DataFrame:
    """One-way ANOVA F over the listed levels of ``label``."""
    v = df.filter(F.col(value).isNotNull())
    if levels is not None:
        v = v.filter(F.col(label).isin(*levels))
    return _finish_f(_oneway(v, value, label, groups), with_p)


@single_series
def levene(df: DataFrame, value: str, label: str, groups: list[str], levels: list | None = DUMMY_LEVELS,
           with_p: bool = False) -> DataFrame:
    """Levene's test with the median as centre (Brown-Forsythe): ANOVA on |x - median|."""
    v = df.filter(F.col(value).isNotNull())
    if levels is not None:
        v = v.filter(F.col(label).isin(*levels))
    med = quantiles(v, value, [*groups, label], [0.5]).select(*groups, label, F.col("_q")[0].alias("_med"))
    z = v.join(med, [*groups, label]).withColumn("_z", F.abs(F.col(value) - F.col("_med")))
    return _finish_f(_oneway(z, "_z", label, groups), with_p)


# Fixed coefficients of Royston's polynomial corrections for the two largest weights.
_SW_C1 = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
_SW_C2 = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]


def _poly(coefs: list[float], x: Column) -> Column:
    out = F.lit(coefs[-1])
    for c in reversed(coefs[:-1]):
        out = out * x + F.lit(c)
    return out


@single_series
def shapiro(df: DataFrame, value: str, groups: list[str], with_p: bool = True, buckets: int = 64) -> DataFrame:
    """Shapiro-Wilk W (and p) per group of any size n >= 3 (below: NULL with a reason).

    Ranks come from counts of distinct values and a bucketed running sum
    (``prefix_counts``), so no group is ordered inside one task. The expected
    normal order statistics m follow from rank and n alone, and W needs only
    grouped sums: Σm², Σmx, Σ(x - mean)² and the two smallest and largest values.
    The sums of m and m² over the ranks of a tied value have a closed form
    (``rank_sums``), so a tie of any length is one row.
    """
    from prepcast.functions.normal import norm_ppf
    from prepcast.functions.order_stats import rank_sums

    v = df.filter(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("_x"))
    sizes = v.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), (F.var_pop("_x") * F.count(F.lit(1))).alias("_ss"))
    cnt = v.groupBy(*groups, "_x").agg(F.count(F.lit(1)).alias("_c"))
    n = F.col("n")
    enough = sizes.filter("n >= 3")
    for k, name in ((0, "_mn"), (1, "_mn1")):  # the two largest order statistics
        enough = enough.withColumn("_p", (n - k - 0.375) / (n + 0.25)).withColumn(name, norm_ppf("_p"))
    ranked = prefix_counts(cnt, groups, "_x", "_c", buckets).join(enough.drop("_p"), groups)
    ranked = rank_sums(ranked.withColumns({"_lo": F.col("_before") + 1, "_hi": F.col("_before") + F.col("_c")}), "_lo", "_hi", "n")
    at = lambda k: F.max(F.when(k.between(F.col("_lo"), F.col("_hi")), F.col("_x")))
    agg = ranked.groupBy(*groups, "n", "_ss", "_mn", "_mn1").agg(
        F.sum("_m2").alias("_ssm"), F.sum(F.col("_m1") * F.col("_x")).alias("_mx"),
        at(F.lit(1)).alias("_x1"), at(F.lit(2)).alias("_x2"), at(n - 1).alias("_y2"), at(n).alias("_y1"),
    )
    u = F.lit(1.0) / F.sqrt(n)
    an = F.col("_mn") / F.sqrt("_ssm") + _poly(_SW_C1, u)
    an1 = F.col("_mn1") / F.sqrt("_ssm") + _poly(_SW_C2, u)
    outer, inner = F.col("_y1") - F.col("_x1"), F.col("_y2") - F.col("_x2")
    phi = F.when(n > 5, (F.col("_ssm") - 2 * F.col("_mn") ** 2 - 2 * F.col("_mn1") ** 2) / (1 - 2 * an**2 - 2 * an1**2)) \
        .otherwise((F.col("_ssm") - 2 * F.col("_mn") ** 2) / (1 - 2 * an**2))
    # the two extreme weights on each side (one for n <= 5) replace m / sqrt(phi)
    rest = (F.col("_mx") - F.col("_mn") * outer - F.when(n > 5, F.col("_mn1") * inner).otherwise(F.lit(0.0))) / F.sqrt(phi)
    ax = F.when(n == 3, F.lit(0.5 ** 0.5) * outer).otherwise(
        rest + an * outer + F.when(n > 5, an1 * inner).otherwise(F.lit(0.0)))
    w = agg.select(*groups, "n", F.least(F.lit(1.0), div(ax ** 2, F.col("_ss"))).alias("_w"), F.lit(None).cast("string").alias("reason"))
    small = sizes.filter("n < 3").select(*groups, "n", F.lit(None).cast("double").alias("_w"), F.lit("n<3").alias("reason"))
    res = w.unionByName(small)
    out = res.select(*groups, "n", _r(F.col("_w")).alias("W"), "reason", "_w")
    if with_p:
        from prepcast.functions.tails import shapiro_p_sql

        # W bound to a name: its own expression is long, and the formula names it often
        out = out.withColumn("p", _r(F.expr(f"element_at(transform(array(named_struct('w', _w, 'n', n)), q -> {shapiro_p_sql('q.w', 'q.n')}), 1)")))
        out = out.withColumn("normal", F.when(F.col("p").isNull(), F.lit(None).cast("boolean")).otherwise(F.col("p") > ALPHA))
    return out.drop("_w")


def prefix_counts(cnt: DataFrame, groups: list[str], value: str, count: str, buckets: int = 64,
                  checkpoint: bool = True) -> DataFrame:
    """Add ``_before``: the sum of ``count`` over smaller ``value`` within the group.

    A running sum over a whole group would put the group into one task. Here
    each group's values are cut into ``buckets`` ranges by approximate
    quantiles (cut points written once to the shared checkpoint folder, so
    every use sees the same ones);
    bucket totals give each bucket's offset (a window over at most ``buckets``
    rows per group) and a running sum inside each (group, bucket) gives the
    rest. Exact whatever the cut points are; they only balance the buckets.
    """
    fr = [i / buckets for i in range(1, buckets)]
    cuts = cnt.groupBy(*groups).agg(F.percentile_approx(value, fr, 10000).alias("_cuts"))
    if checkpoint:
        from prepcast.session import written_table

        cuts = written_table(cuts, "rank-cuts", groups)
    b = cnt.join(cuts, groups, "inner").withColumn(
        "_bucket", F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    ).drop("_cuts")
    totals = b.groupBy(*groups, "_bucket").agg(F.sum(count).alias("_tot"))
    offsets = totals.withColumn("_off", F.coalesce(F.sum("_tot").over(
        Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = Window.partitionBy(*groups, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("_local", F.coalesce(F.sum(count).over(local), F.lit(0)))
    return b.join(offsets.select(*groups, "_bucket", "_off"), [*groups, "_bucket"]).withColumn(
        "_before", F.col("_off") + F.col("_local")).drop("_off", "_local", "_bucket")


EXACT_MAX = 50  # differences up to which the exact null distribution of the signed ranks is counted


def _both_p(out: DataFrame, with_p: bool) -> DataFrame:
    """Add p_exact and p_approx with their decisions.

    The exact distribution is counted by shifts: a rank r adds, to the number of ways to
    reach each sum, that of the sum less r. Ranks are doubled, so those of ties are
    whole. It depends on the ranks alone and is counted once for each tie pattern.
    """
    if not with_p:
        return out
    from prepcast.functions.normal import norm_sf_sql

    ranks = "flatten(transform(_ties, t -> array_repeat(t.r, CAST(t.c AS INT))))"
    ways = (f"aggregate({ranks}, array(1D), (c, k) -> transform(sequence(0, size(c) - 1 + CAST(k AS INT)), "
            f"s -> coalesce(get(c, s), 0D) + IF(s >= k, coalesce(get(c, s - CAST(k AS INT)), 0D), 0D)))")
    patterns = out.select("_ties").where(F.size("_ties") > 0).distinct().withColumn("_ways", F.expr(ways))
    j = out.join(patterns, "_ties", "left")
    low = "aggregate(slice(_ways, 1, CAST(floor(2 * _stat) AS INT) + 1), 0D, (a, v) -> a + v)"
    j = j.withColumn("p_exact", _r(F.expr(f"IF(_ways IS NULL, NULL, least(1D, 2 * {low} / pow(2D, n)))")))
    j = j.withColumn("p_approx", _r(F.expr(f"IF(n = 0, NULL, 2 * {norm_sf_sql('abs(_z)')})")))
    return j.withColumns({"decision_exact": decision(F.col("p_exact")), "decision_approx": decision(F.col("p_approx"))}).drop("_ways")


@single_series
def wilcoxon(df: DataFrame, x: str, y: str, groups: list[str], with_p: bool = False, buckets: int = 64,
             method: str = "auto") -> DataFrame:
    """Wilcoxon signed-rank on x - y: zeros dropped, tied |d| get average ranks,
    statistic = min(W+, W-). ``zeros`` counts the dropped differences; a group
    of zeros only has n = 0 and no p.

    ``method``: "approx" (normal, tie-corrected), "exact" (null distribution by
    counting; cubic in n) or "auto", the rule of the libraries this test is
    compared with: exact up to 50 differences without zeros and ties. "both" decides
    nothing: ``p_exact``, the null distribution of the ranks at hand, ties included
    (NULL beyond ``EXACT_MAX`` differences), stands beside ``p_approx``.

    Ranks come from counts of distinct |d| values and a bucketed running sum
    over the distinct values (``prefix_counts``), so ties are free and no
    group is ordered inside a single task.
    """
    if method not in ("auto", "exact", "approx", "both"):
        raise ValueError(f"unknown method {method}")
    every = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*groups, (F.col(x) - F.col(y)).alias("_d"))
    zeros = every.groupBy(*groups).agg(F.count(F.when(F.col("_d") == 0, 1)).alias("zeros"))
    d = every.filter(F.col("_d") != 0).withColumn("_a", F.abs("_d"))
    cnt = d.groupBy(*groups, "_a").agg(
        F.count(F.lit(1)).alias("_c"), F.sum(F.when(F.col("_d") > 0, 1).otherwise(0)).alias("_pos")
    )
    ranked = prefix_counts(cnt, groups, "_a", "_c", buckets).withColumn(
        "_rank", F.col("_before") + (F.col("_c") + 1) / 2.0
    )
    agg = ranked.groupBy(*groups).agg(
        F.sum("_c").alias("n"),
        F.sum(F.col("_pos") * F.col("_rank")).alias("w_plus"),
        F.sum((F.col("_c") - F.col("_pos")) * F.col("_rank")).alias("w_minus"),
        F.sum(F.col("_c") ** 3 - F.col("_c")).alias("_tie"),
        F.max("_c").alias("_maxc"),
        # twice each rank, with its count; the ranks of a group within EXACT_MAX are among these, and at most so many
        F.array_sort(F.collect_list(F.when(F.col("_before") < EXACT_MAX, F.struct((2 * F.col("_before") + F.col("_c") + 1).cast("long").alias("r"), F.col("_c").alias("c"))))).alias("_ties"),
    )
    agg = zeros.join(agg, groups, "left").fillna(0, ["n"])
    n = F.col("n").cast("double")
    mean = n * (n + 1) / 4.0
    se = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("_tie") / 48.0)
    stat = F.least("w_plus", "w_minus")
    clean = (F.coalesce("_maxc", F.lit(0)) == 1) & (F.col("zeros") == 0)
    if method == "both":
        out = agg.select(*groups, "n", "zeros", _r(F.col("w_plus")).alias("w_plus"), _r(F.col("w_minus")).alias("w_minus"),
                         _r(stat).alias("statistic"), stat.alias("_stat"), div(stat - mean, se).alias("_z"), F.when(F.col("n") <= EXACT_MAX, F.col("_ties")).alias("_ties"))
        return _both_p(out, with_p).withColumn("z", _r(F.col("_z"))).drop("_z", "_ties", "_stat")
    rule = {"auto": (F.col("n") <= 50) & clean, "exact": F.lit(True), "approx": F.lit(False)}[method]
    out = agg.select(*groups, "n", "zeros", _r(F.col("w_plus")).alias("w_plus"), _r(F.col("w_minus")).alias("w_minus"),
                     _r(stat).alias("statistic"), div(stat - mean, se).alias("_z"),
                     rule.alias("exact"))
    if with_p:
        from prepcast.functions.tails import wilcoxon_p_sql

        out = out.withColumn("p", _r(F.expr(wilcoxon_p_sql("statistic", "n", "_z", "exact"))))
        out = out.withColumn("decision", decision(F.col("p")))
    return out.withColumn("z", _r(F.col("_z"))).drop("_z")
