"""Facts with a key, a tier and an expiry, as versions of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dedup, mutation


def live(facts: DataFrame, as_of: Column) -> DataFrame:
    """Facts that have not expired; no expiry is for ever."""
    return facts.filter(F.col("expires_at").isNull() | (F.col("expires_at") > as_of))


def remember(facts: DataFrame, new: DataFrame, order: str = "updated_at") -> DataFrame:
    """The table with new facts in their key's place; the latest of a key wins."""
    return mutation.upsert(facts, new, ["id"], order)


def forget(facts: DataFrame, ids: DataFrame) -> DataFrame:
    return mutation.delete(facts, ids, ["id"])


def recall(facts: DataFrame, as_of: Column, words: list[str], most: int = 20) -> DataFrame:
    """Live facts by how many of the words they hold, then the newest."""
    hits = F.lit(0)
    for w in words:
        hits = hits + F.when(F.lower("content").contains(w.lower()), 1).otherwise(0)
    return live(facts, as_of).withColumn("hits", hits).filter("hits > 0").orderBy(F.desc("hits"), F.desc("updated_at"), "id").limit(most)


def latest_soul(souls: DataFrame) -> DataFrame:
    """The current version of each profile."""
    return dedup.latest(souls, ["soul_id"], [F.desc("version")])
