"""Orders and bounded lists."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.normalize import phrase


def display_order(kind: str, query: str = "", title: str = "title", year: str = "year", citations: str = "citations", order: str = "ord", collation: str = "UNICODE") -> list[Column]:
    """Sort keys of a result list: relevance, date, citations or title.

    Titles compare by a collation: letters before accents before case, ``UNICODE``
    or a language's own such as ``de`` or ``es``.
    """
    keys = {
        "relevance": [],
        "date": [F.desc_nulls_last(F.col(year).cast("string"))],
        "citations": [F.desc(F.coalesce(citations, F.lit(0)))],
        "title": [F.desc(title_tier(F.col(title), query)), F.collate(title, collation)],
    }
    return [*keys[kind], F.asc(order)]


def title_tier(title: Column, query: str) -> Column:
    """2 if the title begins with the phrase, 1 if it holds it, else 0."""
    q = phrase(F.lit(query))
    t = F.concat(F.lit(" "), phrase(title), F.lit(" "))
    hit = F.concat(F.lit(" "), q, F.lit(" "))
    return F.when(q == "", 0).when(F.startswith(t, hit), 2).when(F.contains(t, hit), 1).otherwise(0)


def soft_sort(words: list[str], title: str = "title", order: str = "ord") -> list[Column]:
    """Rows whose title holds any word first, else as they came."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.lower(title).contains(w.lower())
    return [F.desc(F.coalesce(hit, F.lit(False))), F.asc(order)]


def under_budget(df: DataFrame, size: str, at: str, budget: int, tie: str) -> DataFrame:
    """The most recent rows whose sizes together stay within the budget.

    Running sums are taken by day first, so the global sum runs over days, not
    rows; rows are then summed within the one day where the budget ends.
    """
    day = F.to_date(at)
    days = df.groupBy(day.alias("_d")).agg(F.sum(size).alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.orderBy(F.desc("_d")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.withColumn("_before", before).select("_d", "_before")
    inside = F.sum(size).over(Window.partitionBy("_d").orderBy(F.desc(at), tie))
    out = df.withColumn("_d", day).join(days, "_d").withColumn("_run", F.col("_before") + inside)
    return out.filter(F.col("_run") <= budget).select(*df.columns)


def flatten_tree(spark: SparkSession, nodes: DataFrame, key: str, parent: str, name: str, checkpoint: Callable[[DataFrame], DataFrame] = DataFrame.checkpoint) -> DataFrame:
    """(key, name, depth, path) in pre-order of ``path``, siblings by name.

    One join a level until no row is left; ``checkpoint`` writes each level, so
    plans do not grow with the depth.  Rows on a cycle hang on no root and are absent.
    """
    part = F.struct(F.col(name).alias("n"), F.col(key).cast("string").alias("k"))
    level = nodes.filter(F.col(parent).isNull()).select(F.col(key).alias("id"), F.col(name).alias("name"), F.lit(0).alias("depth"), F.array(part).alias("path"))
    out = level
    for depth in count(1):
        if level.isEmpty():
            return out
        kids = nodes.select(F.col(key).alias("id"), F.col(name).alias("name"), F.col(parent).alias("_p"), part.alias("_part"))
        level = checkpoint(kids.join(level.select(F.col("id").alias("_i"), F.col("path").alias("_path")), F.col("_p") == F.col("_i")).select("id", "name", F.lit(depth).alias("depth"), F.concat("_path", F.array("_part")).alias("path")))
        out = out.unionByName(level)
