"""Rank fusion of retrieval channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANK_CONSTANT = 60


def rrf(hits: DataFrame, ids: list[str], weight: Column | None = None, constant: int = RANK_CONSTANT) -> DataFrame:
    """Sum of weight / (rank + constant) over (channel, id, rank) rows."""
    w = weight if weight is not None else F.lit(1.0)
    return hits.groupBy(*ids).agg(F.sum(w / (F.col("rank") + constant)).alias("score"), F.array_sort(F.collect_set("channel")).alias("channels"))


def hybrid_items(vector: DataFrame, text: DataFrame, threshold: float, limit: int) -> DataFrame:
    """Best chunk for each item from two ranked channels.

    ``vector`` has id, item_id, rank and similarity, ``text`` id, item_id and
    rank.  The similarity gate comes before the best chunk is chosen and holds
    only for chunks with a similarity, so a failed chunk never stands in for
    its item.
    """
    both = vector.select(F.lit("vector").alias("channel"), "id", "item_id", "rank", "similarity").unionByName(text.select(F.lit("text").alias("channel"), "id", "item_id", "rank", F.lit(None).cast("double").alias("similarity")))
    fused = both.groupBy("id", "item_id").agg(F.sum(1.0 / (F.col("rank") + RANK_CONSTANT)).alias("score"), F.max("similarity").alias("similarity"))
    passed = fused.filter(F.col("similarity").isNull() | (F.col("similarity") >= threshold))
    best = passed.groupBy("item_id").agg(F.max_by(F.struct("id", "score", "similarity"), F.struct("score", -F.col("id"))).alias("b"))
    return best.select("item_id", "b.id", "b.score", "b.similarity").orderBy(F.desc("score"), "id").limit(limit)


def with_host(items: DataFrame, host: DataFrame, limit: int, host_weight: float = 0.5) -> DataFrame:
    """Item ranks fused again with a plain hit list of lower weight.

    ``items`` has item_id and score.  Ranks are over a result list that is
    already limited.  Without host hits the items come back in their order.
    """
    ranked = items.select("item_id", F.row_number().over(Window.orderBy(F.desc("score"), "item_id")).alias("rank"), F.lit("hybrid").alias("channel"))
    both = ranked.unionByName(host.select("item_id", "rank", F.lit("host").alias("channel")))
    w = F.when(F.col("channel") == "host", host_weight).otherwise(1.0)
    return rrf(both, ["item_id"], w).orderBy(F.desc("score"), "item_id").limit(limit)
