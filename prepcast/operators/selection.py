"""Exact quantiles of groups of any size, without a state that holds a group's values.

``percentile`` keeps every distinct value of a group in one task. Here a first pass
builds a sketch of bounded size per group, whose rank error is known: it brackets
each wanted order statistic between two values. A second pass counts: rows below the
bracket and above it fall into one counter each, rows within it are counted by
value. About 8 / ``accuracy`` of a group's rows lie within a bracket, and only these are
ordered. Both passes combine on the map side, so a group with a third of all rows costs
every task its share and no more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prepcast.functions.columns import join_groups, single_series

ACCURACY = 10_000


@single_series
def quantiles(df: DataFrame, value: str, groups: list[str], probs: list[float], accuracy: int = ACCURACY) -> DataFrame:
    """(groups, _n, _q): number of non-null values and the linearly interpolated quantiles at ``probs``.

    Exact whatever the sketch says: a bracket that missed its order statistic would
    end the job with an error, never with a wrong value.
    """
    k, room = len(probs), 4.0 / accuracy
    asked = [max(0.0, p - room) for p in probs] + [min(1.0, p + room) for p in probs]
    v = df.where(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("_x"))
    sketch = v.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_x", asked, accuracy).alias("_b"))
    # below the bracket: no value (sorts first), of which only the greatest counts; above it: NaN (sorts last), of which only the least does
    place = F.expr(f"transform(sequence(0, {k - 1}), i -> named_struct('i', i, 'at', "
                   f"CASE WHEN _x < _b[i] THEN NULL WHEN _x <= _b[i + {k}] THEN _x ELSE CAST('NaN' AS DOUBLE) END))")
    counted = join_groups(v, sketch, groups).select(*groups, "_n", "_x", F.inline(place)).groupBy(*groups, "_n", "i", "at").agg(
        F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_least"), F.max("_x").alias("_most"))
    counted = counted.repartition(*groups)  # few rows; serves the window and the last aggregates
    upto = F.sum("_c").over(Window.partitionBy(*groups, "_n", "i").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    pos = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("i") + 1) * (F.col("_n") - 1)
    ranked = counted.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_c") + 1).withColumn("_pos", pos).withColumn("_r", F.floor("_pos") + 1)

    def at(rank: Column) -> Column:
        here = (rank >= F.col("_from")) & (rank <= F.col("_to"))
        known = F.when(F.col("at").isNull(), F.when(rank == F.col("_to"), F.col("_most"))).when(F.isnan("at"), F.when(rank == F.col("_from"), F.col("_least"))).otherwise(F.col("at"))
        return F.max(F.when(here, known))

    one = ranked.groupBy(*groups, "_n", "i").agg(at(F.col("_r")).alias("_a"), at(F.col("_r") + 1).alias("_z"), F.max("_pos").alias("_pos"))
    part = F.col("_pos") - F.floor("_pos")
    missed = F.raise_error(F.lit("a quantile's bracket missed it")).cast("double")
    exact = F.when(F.col("_a").isNull(), missed).when(part == 0, F.col("_a")).when(F.col("_z").isNull(), missed).otherwise(F.col("_a") * (1 - part) + F.col("_z") * part)
    return one.groupBy(*groups, "_n").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", exact.alias("q")))), lambda s: s["q"]).alias("_q"))
