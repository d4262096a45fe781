"""Country codes through dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normalised(rows: DataFrame, code: str, dimension: DataFrame, overrides: DataFrame, unknown: str = "?") -> DataFrame:
    """rows with the three-letter code (alpha3) of a two-letter one (alpha2), whatever its case and white space; overrides come before the dimension, both have a row a country."""
    table = lambda d, name: F.broadcast(d.select(F.upper("alpha2").alias("_k"), F.col("alpha3").alias(name)).dropDuplicates(["_k"]))  # noqa: E731  (countries)
    keyed = rows.withColumn("_k", F.upper(F.trim(code)))
    told = keyed.join(table(dimension, "_d"), "_k", "left").join(table(overrides, "_o"), "_k", "left")
    return told.withColumn(code, F.coalesce("_o", "_d", F.lit(unknown))).drop("_k", "_d", "_o")
