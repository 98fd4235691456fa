"""Look-back windows over one long series, in many tasks.

``Window.orderBy(date)`` without an entity puts the whole series into one partition.
Here every row gets its place in the series (``prefix_counts``, exact and in
parallel), the series is cut into blocks of ``block`` places, and the last ``back`` rows of each block are
also sent, marked as halo, to the next. A window per block then sees for each of its own
rows the same ``back`` predecessors as a window over the whole series, whatever
gaps the dates have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prepcast.functions.columns import SERIES
from prepcast.operators.stats import prefix_counts

BLOCK = 4096


def look_back(df: DataFrame, keys: list[str], order: str, back: int, columns, block: int = BLOCK) -> DataFrame:
    """``df`` with ``columns(window)`` (name -> Column) of frames that reach at most ``back`` rows back, per ``keys`` by ``order`` (a date, unique per key)."""
    if block < back:
        raise ValueError("a block must hold the rows looked back to")
    keyed = df.withColumn(SERIES, F.lit(0)).withColumn("_day", F.coalesce(F.unix_date(order), F.lit(-(2**31))))
    counts = keyed.groupBy(SERIES, *keys, "_day").agg(F.count(F.lit(1)).alias("_c"))
    places = prefix_counts(counts, [SERIES, *keys], "_day", "_c").select(SERIES, *keys, "_day", "_before")
    placed = keyed.join(places, [SERIES, *keys, "_day"])
    mine = F.floor(F.col("_before") / block)
    entry = lambda b, halo: F.struct(b.cast("long").alias("_block"), F.lit(halo).alias("_halo"))
    dealt = placed.withColumn("_in", F.explode(F.when(F.col("_before") % block >= block - back, F.array(entry(mine, False), entry(mine + 1, True))).otherwise(F.array(entry(mine, False)))))
    dealt = dealt.select(*[c for c in dealt.columns if c != "_in"], "_in.*")
    window = Window.partitionBy(*keys, "_block").orderBy(order)
    made: dict[str, Column] = columns(window)
    return dealt.withColumns(made).where(~F.col("_halo")).drop(SERIES, "_day", "_before", "_block", "_halo")
