"""Joins whose keys may be very uneven."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of the rows is hot; its inverse bounds the hot keys.
HOT_SHARE = 1 / 1000
#: No key with fewer rows is hot.
LEAST_HOT = 64


def cold_limit(table: DataFrame, many: str = "many") -> int:
    """Keys with more rows are hot: the most frequent ones, fewer than 1 / HOT_SHARE."""
    most = round(1 / HOT_SHARE)
    top = table.filter(F.col(many) > LEAST_HOT).select(F.col(many).alias("many")).orderBy(F.desc("many")).limit(most).agg(F.min("many").alias("least"), F.count("*").alias("keys")).first()
    return top.least if top.keys == most else LEAST_HOT


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], many: str = "many") -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each key and its number of rows.

    The most frequent keys, fewer than 1 / HOT_SHARE at any size and among them
    all with more than ``HOT_SHARE`` of the rows, are broadcast, so their rows stay
    where they are.  All others meet by a shuffle in which no task holds a hot key.
    Hot keys go by their order, not by a share of all rows: so the plan, and how many
    rows the anti join passes on, hardly depend on how uneven the keys are.
    ``many`` is not returned.  Both inputs are read more than once: pass written tables.
    """
    limit = cold_limit(table, many)
    hot, rest = table.filter(F.col(many) > limit).drop(many), table.filter(F.col(many) <= limit).drop(many)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest.hint("merge"), keys)
    return cold.unionByName(rows.join(F.broadcast(hot), keys))
