"""Usage analytics over an event log; dates are relative to an explicit as_of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP_GROUPS = 100


def by_group(events: DataFrame, group: str, measures: Sequence[str], most: int | None = None) -> DataFrame:
    """Count and sums by group, largest first; with ``most``, null groups are left out."""
    rows = events.filter(F.col(group).isNotNull()) if most else events
    out = rows.groupBy(group).agg(F.count("*").alias("n"), *(F.coalesce(F.sum(m), F.lit(0)).alias(f"sum_{m}") for m in measures))
    return out.orderBy(F.desc(f"sum_{measures[0]}"), group).limit(most) if most else out


def by_groupings(events: DataFrame, groups: Sequence[str], measure: str) -> DataFrame:
    """All groupings of one filtered log from one pass: (dimension, value, n, total)."""
    sets = F.explode(F.array(*(F.struct(F.lit(g).alias("dimension"), F.col(g).cast("string").alias("value")) for g in groups)))
    return events.select(sets.alias("g"), measure).groupBy("g.dimension", "g.value").agg(F.count("*").alias("n"), F.sum(measure).alias("total"))


def totals(events: DataFrame, measures: Sequence[str]) -> DataFrame:
    return events.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(m), F.lit(0.0)).alias(f"sum_{m}") for m in measures))


def day_total(events: DataFrame, as_of: str, at: str, measure: str) -> DataFrame:
    """Total of the day of ``as_of``."""
    return events.filter(F.to_date(at) == F.to_date(F.lit(as_of))).agg(F.coalesce(F.sum(measure), F.lit(0.0)).alias("today"))


def month_over_month(events: DataFrame, as_of: str, at: str, measure: str) -> DataFrame:
    """This and last calendar month, change in percent and its direction.

    From nothing the change is 100 if there is something now, else 0.
    """
    month = F.trunc(F.lit(as_of).cast("date"), "month")
    own = F.trunc(F.col(at), "month")
    s = events.agg(F.coalesce(F.sum(F.when(own == month, F.col(measure))), F.lit(0.0)).alias("current"), F.coalesce(F.sum(F.when(own == F.add_months(month, -1), F.col(measure))), F.lit(0.0)).alias("previous"))
    change = F.when(F.col("previous") == 0, F.when(F.col("current") > 0, 100.0).otherwise(0.0)).otherwise((F.col("current") - F.col("previous")) / F.col("previous") * 100)
    return s.withColumn("change", change).withColumn("direction", F.when(F.col("change") > 0.5, "up").when(F.col("change") < -0.5, "down").otherwise("flat"))


def daily(events: DataFrame, as_of: str, at: str, measure: str, weeks: int = 53) -> DataFrame:
    """Count and total of each day in the last weeks."""
    end = F.lit(as_of).cast("date")
    day = F.to_date(at)
    return events.filter((day > F.date_sub(end, 7 * weeks)) & (day <= end)).groupBy(day.alias("day")).agg(F.count("*").alias("n"), F.sum(measure).alias("total"))


def pivot_counts(df: DataFrame, row: str, column: str, values: Sequence[str], rest: str) -> DataFrame:
    """Counts of each row by known column values; unknown values count as ``rest``."""
    kind = F.when(F.col(column).isin(*values), F.col(column)).otherwise(rest)
    return df.groupBy(row).agg(*(F.count_if(kind == v).alias(v) for v in dict.fromkeys([*values, rest])))


def facet_counts(df: DataFrame, sources: str) -> DataFrame:
    """Rows of each value of a list column."""
    return df.select(F.explode(F.array_distinct(sources)).alias("source")).groupBy("source").agg(F.count("*").alias("n"))


def name_counts(df: DataFrame, name: str, key: Column, order: str) -> DataFrame:
    """Count by normal form, shown as first spelt."""
    return df.withColumn("_k", key).filter("_k is not null").groupBy("_k").agg(F.min_by(name, order).alias("name"), F.count("*").alias("n")).select(F.col("_k").alias("key"), "name", "n")


def score_buckets(df: DataFrame, score: str) -> DataFrame:
    """How many scores lie at 70 or over, from 50 on, and under 50."""
    s = F.col(score)
    return df.agg(F.count_if(s >= 70).alias("high"), F.count_if((s >= 50) & (s < 70)).alias("medium"), F.count_if(s < 50).alias("low"))


def learnt_queries(df: DataFrame, query: str, score: str, host: str, top: int = 5) -> DataFrame:
    """Mean score and count of each query, with the hosts it found most."""
    hosts = df.groupBy(query, host).agg(F.count("*").alias("_n"), F.sum(score).alias("_s"))
    best = hosts.withColumn("_r", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("_n"), host))).filter(F.col("_r") <= top)  # few rows leave each task
    best = best.groupBy(F.col(query).alias("_q")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_r").alias("r"), F.col(host).alias("h")))), lambda x: x["h"]).alias("hosts"))
    totals = hosts.groupBy(query).agg((F.sum("_s") / F.sum("_n")).alias("mean_score"), F.sum("_n").alias("n"))
    return totals.join(best, F.col(query).eqNullSafe(F.col("_q"))).drop("_q")


# ---- fixed values: from which mean score and count on a query counts as effective, and under which as ineffective
EFFECTIVE_SCORE, EFFECTIVE_COUNT, INEFFECTIVE_SCORE = 60, 3, 30


def judged_queries(entries: DataFrame, most: int = 20) -> DataFrame:
    """(verdict, rank, query, mean_score): the best effective and the worst ineffective queries.

    ``entries`` has a row for each query with mean_score and n.
    """
    s = F.col("mean_score")
    verdict = F.when((s >= EFFECTIVE_SCORE) & (F.col("n") >= EFFECTIVE_COUNT), "effective").when(s < INEFFECTIVE_SCORE, "ineffective")
    rows = entries.select(verdict.alias("verdict"), "query", "mean_score").filter("verdict is not null")
    best = Window.partitionBy("verdict").orderBy(F.when(F.col("verdict") == "effective", -s).otherwise(s), "query")
    return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most).select("verdict", "rank", "query", "mean_score")


def quality_hosts(entries: DataFrame) -> DataFrame:
    """(host, n): hosts among the top hosts of queries whose mean scores are high, and in how many."""
    rows = entries.filter(F.col("mean_score") >= EFFECTIVE_SCORE).select("mean_score", F.explode("hosts").alias("host"))
    out = rows.groupBy("host").agg(F.avg("mean_score").alias("_m"), F.count("*").alias("n"))
    return out.filter(F.col("_m") >= EFFECTIVE_SCORE).select("host", "n")


def session_totals(events: DataFrame, session: str, at: str, model: str, measures: Sequence[str], as_of: Column, most_hours: int = 24, many: int = 100) -> DataFrame:
    """Sums of each session with its first model; with over ``many`` sessions the idle ones go.

    Idle is what has no event in the ``most_hours`` before ``as_of``.
    """
    sums = [F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures]
    out = events.groupBy(session).agg(*sums, F.min_by(model, F.when(F.col(model).isNotNull(), F.struct(at, model))).alias("model"), F.max(at).alias("last_at"))
    over = out.agg((F.count("*") > many).alias("_over"))
    idle = F.col("last_at") < as_of - F.make_dt_interval(F.lit(0), F.lit(most_hours))
    return out.crossJoin(F.broadcast(over)).filter(~(F.col("_over") & idle)).drop("_over")  # over: one row
