"""Stored Gram tables: recurring fits and diagnoses read only the rows that changed.

A model's Gram sums are taken about shifts that stay with the table, so sums of further rows
can be added and those of withdrawn rows subtracted. ``refresh`` reads the withdrawn and
the added rows, merges one row per group and model, and publishes a new version; readers see the
former one until it is complete, and a refresh that fails leaves it in place.

Groups that the table doesn't hold yet take the means of their added rows as shifts. A group and
model left without rows goes. Subtracting leaves the rounding of what was added before, about
1e-16 of its squares: withdrawn values 10 million residual spreads off the mean cost residual sums
all but two or three digits, and then ``create`` should build the table from rows again. Rows whose group is null are not held.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepcast.operators.regression import column_means, model_columns, model_grams
from prepcast.sources.publish import publish, published

NAME = "grams"


def create(path: str, rows: DataFrame, models: dict[str, list[str]], target: str, groups: list[str]) -> str:
    """Publish the Gram table of ``rows`` and return its version."""
    return publish({NAME: model_grams(rows, models, target, groups).where("n > 0")}, path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The last version, in the form of ``model_grams``."""
    return published(spark, path, NAME)


def shifts(grams: DataFrame, names: list[str], target: str, groups: list[str]) -> DataFrame:
    """(groups, ``_c_<name>``): the shifts a Gram table was built about; null for columns none of the group's models has."""
    pairs = F.arrays_zip(F.concat("terms", F.array(F.lit(target))).alias("name"), F.col("shift").alias("at"))
    each = grams.select(*groups, F.explode(pairs).alias("p")).select(*groups, "p.*")
    return each.groupBy(*groups).agg(*[F.max(F.when(F.col("name") == c, F.col("at"))).alias(f"_c_{c}") for c in names])


def merge(grams: DataFrame, withdrawn: DataFrame, added: DataFrame, models: dict[str, list[str]], target: str, groups: list[str]) -> DataFrame:
    """The Gram table without the ``withdrawn`` rows and with the ``added`` ones; all three about the table's shifts."""
    names = model_columns(models, target)
    old, new = shifts(grams, names, target, groups), column_means(added, names, groups)
    about = old.join(new.select(*groups, *[F.col(f"_c_{c}").alias(f"_n_{c}") for c in names]), groups, "full").select(
        *groups, *[F.coalesce(f"_c_{c}", f"_n_{c}", F.lit(0.0)).alias(f"_c_{c}") for c in names])
    minus = model_grams(withdrawn, models, target, groups, about).withColumns({"n": -F.col("n"), "gram": F.transform("gram", lambda v: -v)})
    parts = grams.unionByName(model_grams(added, models, target, groups, about)).unionByName(minus)
    k = max(map(len, models.values())) + 2
    size = k * (k + 1) // 2
    total = parts.groupBy(*groups, "model", "terms").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.get("gram", F.lit(i))) for i in range(size)]).alias("gram"), F.max("shift").alias("shift"))
    return total.where("n > 0").withColumn("gram", F.filter("gram", lambda v: v.isNotNull()))


def refresh(path: str, withdrawn: DataFrame, added: DataFrame, models: dict[str, list[str]], target: str, groups: list[str]) -> str:
    """Publish the table at ``path`` after rows were withdrawn and added, and return the new version."""
    return publish({NAME: merge(stored(added.sparkSession, path), withdrawn, added, models, target, groups)}, path)
