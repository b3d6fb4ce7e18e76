"""Look-ups: metrics by any of several keys, marking, anti joins, page look-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_per_key(dim: DataFrame, keys: Sequence[Column], order: str) -> DataFrame:
    """(_key, row): a dimension under each of its keys, the last row for a key wins.

    A disjunction of equalities thus becomes one equality, which Spark can
    broadcast or shuffle; no join has an OR in it.
    """
    rows = dim.select(F.explode(F.array_distinct(F.array(*keys))).alias("_key"), F.struct("*").alias("row"), F.col(order).alias("_ord")).filter("_key is not null")
    return rows.groupBy("_key").agg(F.max_by("row", "_ord").alias("row"))


def lookup(facts: DataFrame, key: Column, dim: DataFrame, keys: Sequence[Column], order: str, name: str) -> DataFrame:
    """``facts`` with the dimension's row (a struct, null without a match) as ``name``."""
    d = one_per_key(dim, keys, order).select(F.col("_key").alias("_dim"), F.col("row").alias(name))
    return facts.withColumn("_fact", key).join(d, F.col("_fact") == F.col("_dim"), "left").drop("_fact", "_dim")


def every_match(facts: DataFrame, key: Column, dim: DataFrame, keys: Sequence[Column], name: str) -> DataFrame:
    """``facts`` with each different dimension row that has the key as any of its keys; once, with a null, without a match."""
    d = dim.select(F.explode(F.array_distinct(F.array(*keys))).alias("_dim"), F.struct("*").alias(name)).filter("_dim is not null").distinct()
    return facts.withColumn("_fact", key).join(d, F.col("_fact") == F.col("_dim"), "left").drop("_fact", "_dim")


def cascade(facts: DataFrame, ladder: Sequence[tuple[Column, DataFrame, Sequence[Column], str]], name: str) -> DataFrame:
    """The first match down a ladder of look-ups, with the step that made it."""
    out = facts
    for i, (key, dim, keys, order) in enumerate(ladder):
        out = lookup(out, key, dim, keys, order, f"_hit{i}")
    hits = [F.col(f"_hit{i}") for i in range(len(ladder))]
    step = F.coalesce(*(F.when(h.isNotNull(), F.lit(i)) for i, h in enumerate(hits)))
    return out.withColumn(name, F.coalesce(*hits)).withColumn(f"{name}_step", step).drop(*(f"_hit{i}" for i in range(len(ladder))))


def mark(df: DataFrame, key: Column, known: DataFrame, known_key: Column, name: str = "in_library") -> DataFrame:
    """``df`` with whether its key is known; a row without a key is not."""
    k = known.select(known_key.alias("_known")).filter("_known is not null").distinct()
    return df.withColumn("_k", key).join(k, F.col("_k") == F.col("_known"), "left").withColumn(name, F.col("_known").isNotNull()).drop("_k", "_known")


def drop_known(df: DataFrame, key: Column, known: DataFrame, known_key: Column, order: str = "ord") -> DataFrame:
    """Rows whose key is unknown; rows without a key follow in ``position`` order."""
    k = known.select(known_key.alias("_known")).filter("_known is not null")
    out = df.withColumn("_k", key).join(k, F.col("_k") == F.col("_known"), "left_anti")
    return out.withColumn("keyless", F.col("_k").isNull()).drop("_k")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.join(parent.select(key).distinct(), key, "left_anti")


def stale(stored: DataFrame, now: DataFrame, key: str, text: str) -> DataFrame:
    """Current rows that are not stored, or stored with another text."""
    s = stored.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    return now.join(s, F.col(key) == F.col("_k"), "left").filter(F.col("_k").isNull() | ~F.col(text).eqNullSafe(F.col("_t"))).drop("_k", "_t")


def as_of(left: DataFrame, right: DataFrame, group: str, at: str, value: str, piece: Column | None = None) -> DataFrame:
    """``left`` with the last ``value`` of ``right`` at or before it, by group.

    One union, one shuffle and one running last value; no range join.  ``piece``
    is a function of ``at`` that never falls as it rises, such as its day: a long
    history is then dealt by (group, piece), and each piece gets the last value of
    those before it from a table with a row for each of them.
    """
    rows = left.select(group, at, F.lit(1).alias("_side"), F.struct("*").alias("_row"), F.lit(None).cast(dict(right.dtypes)[value]).alias("_v"), F.lit(False).alias("_has"))
    marks = right.select(group, at, F.lit(0).alias("_side"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"), F.lit(True).alias("_has"))
    both, by = rows.unionByName(marks), [group]
    if piece is not None:
        both, by = both.withColumn("_piece", piece), [group, "_piece"]
    w = Window.partitionBy(*by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_has"), F.struct(F.col("_v"))), ignorenulls=True).over(w)
    found = both.withColumn("_last", last).filter("_side = 1")
    if piece is None:
        return found.select("_row.*", F.col("_last._v").alias(value))
    ends = both.groupBy(*by).agg(F.max_by(F.struct("_v"), F.when(F.col("_has"), F.struct(at, "_v"))).alias("_end"))
    before = Window.partitionBy(group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col(group).alias("_g"), F.col("_piece").alias("_p"), F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    out = found.join(carried, F.col(group).eqNullSafe(F.col("_g")) & F.col("_piece").eqNullSafe(F.col("_p")), "left")
    return out.select("_row.*", F.coalesce("_last", "_carried")["_v"].alias(value))


def page_of(spans: Column, offset: Column) -> Column:
    """Page of the last span that starts at or before the offset, null before the first; spans come sorted."""
    return F.try_element_at(F.filter(spans, lambda s: s["start"] <= offset), F.lit(-1))["page"]
