"""Dedup and merge of records that share a key.

Order decides winners everywhere, so each function takes an explicit arrival
order; nothing depends on the order of partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import missing


def first_filled(column: str, order: str) -> Column:
    """The first non-missing value in arrival order."""
    return F.min_by(F.when(missing(F.col(column).cast("string")).isNotNull(), F.col(column)), F.when(missing(F.col(column).cast("string")).isNotNull(), F.col(order)))


def longest(column: str, order: str) -> Column:
    """The longest text; the earliest among equals."""
    return F.max_by(F.col(column), F.struct(F.length(column), -F.col(order)))


def ordered_union(keyed: DataFrame, column: str, order: str) -> DataFrame:
    """(_u, column): distinct values of a list column for each ``_key``, by arrival.

    The first place of each value is found before values meet in a list, so a
    list holds as many entries as there are values, not rows.
    """
    values = keyed.select("_key", F.col(order).alias("o"), F.col(column).alias("v"), F.posexplode(column).alias("p", "x"))
    firsts = values.groupBy("_key", "x").agg(F.min(F.struct("o", "v", "p")).alias("at")).select("_key", F.struct("at", "x").alias("s"))
    listed = firsts.groupBy("_key").agg(F.transform(F.array_sort(F.collect_list("s")), lambda r: r["x"]).alias(column))
    return listed.withColumnRenamed("_key", "_u")


def merge_articles(df: DataFrame, key: Column, order: str = "ord", fill: Sequence[str] = (), long: Sequence[str] = ("title", "abstract"), most: Sequence[str] = ("citations",), least: Sequence[str] = ("year",), unions: Sequence[str] = ("sources",)) -> DataFrame:
    """One row for each key: longest texts, first filled values, largest counts.

    A row without a key is a record of its own.  ``least`` takes the smallest
    positive number.  The merged row stands where its first record stood.
    """
    keyed = df.withColumn("_key", F.coalesce(F.concat(F.lit("k:"), key), F.concat(F.lit("r:"), F.col(order).cast("string"))))
    made = [longest(c, order).alias(c) for c in long] + [first_filled(c, order).alias(c) for c in fill] + [F.max(c).alias(c) for c in most]
    made += [F.min(F.when(F.col(c) > 0, F.col(c))).alias(c) for c in least]
    out = keyed.groupBy("_key").agg(F.min(order).alias(order), F.count("*").alias("n_merged"), *made)
    for c in unions:
        out = out.join(ordered_union(keyed, c, order), F.col("_key") == F.col("_u"), "left").withColumn(c, F.coalesce(c, F.array().cast(df.schema[c].dataType))).drop("_u")
    return out.drop("_key")


def first_whole(df: DataFrame, key: Column, order: str = "ord", sources: str = "source") -> DataFrame:
    """The first row of each key as it is, with the sources of all; rows without a key go."""
    keyed = df.withColumn("_key", key).filter("_key is not null")
    first = keyed.groupBy("_key").agg(F.min(order).alias("_first"), F.array_sort(F.collect_set(sources)).alias("sources"))
    f = first.withColumnRenamed("_key", "_k")
    return keyed.join(f, (F.col("_key") == F.col("_k")) & (F.col(order) == F.col("_first"))).drop("_key", "_k", "_first")


def latest(df: DataFrame, keys: list[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
