"""Row filters: structured conditions, facets, gates and list predicates."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N

_FIELD = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")
_OPS: dict[str, Callable[[Column, Any], Column]] = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "lt": lambda c, v: c < v,
    "ge": lambda c, v: c >= v,
    "le": lambda c, v: c <= v,
    "like": lambda c, v: c.like(v),
    "in": lambda c, v: c.isin(list(v)),
}


def condition(df: DataFrame, filters: Sequence[dict], combine: str = "and") -> Column:
    """One condition of many {field, op, value}; anything unknown is an error.

    No filter is always true; an empty "in" list is an error as well, since it
    would silently match nothing.
    """
    if combine not in ("and", "or"):
        raise ValueError(f"unknown combination {combine!r}")
    parts = []
    for f in filters:
        name, op, value = f["field"], f["op"], f["value"]
        if not _FIELD.match(name) or name not in df.columns:
            raise ValueError(f"unknown field {name!r}")
        if op not in _OPS:
            raise ValueError(f"unknown operator {op!r}")
        if op == "in" and (isinstance(value, str) or not list(value)):
            raise ValueError("in needs a list with values")
        parts.append(_OPS[op](F.col(name), value))
    if not parts:
        return F.lit(True)
    return reduce((lambda a, b: a & b) if combine == "and" else (lambda a, b: a | b), parts)


def where(df: DataFrame, filters: Sequence[dict], combine: str = "and") -> DataFrame:
    return df.filter(condition(df, filters, combine))


def year_window(df: DataFrame, window: str | None, column: str = "year") -> DataFrame:
    """Rows of a year or "A-B"; an unreadable window filters nothing, a row without a year fails an active one."""
    m = re.match(r"^\s*(\d{4})(?:\s*-\s*(\d{4}))?\s*$", window or "")
    if not m:
        return df
    a, b = sorted((int(m[1]), int(m[2] or m[1])))
    return df.filter(N.year(column).between(a, b))


def any_tag(df: DataFrame, wanted: Sequence[str], tags: str = "tags") -> DataFrame:
    """Rows of which any tag contains any wanted one, whatever the case."""
    words = [w.lower() for w in wanted]
    return df.filter(F.exists(tags, lambda t: reduce(lambda a, b: a | b, [F.lower(t).contains(w) for w in words]))) if words else df


def any_source(df: DataFrame, chosen: Sequence[str], sources: str = "sources") -> DataFrame:
    return df.filter(F.arrays_overlap(F.col(sources), F.array(*map(F.lit, chosen)))) if chosen else df


def capable_sources(sources: DataFrame, active: Sequence[str], supported: str = "supportedFilters") -> tuple[DataFrame, DataFrame]:
    """(kept, skipped): a source stays only if it supports all active filters."""
    lacks = F.size(F.array_except(F.array(*map(F.lit, active)).cast("array<string>"), F.coalesce(supported, F.array().cast("array<string>")))) > 0
    return sources.filter(~lacks), sources.filter(lacks)


def blacklist(df: DataFrame, banned: Sequence[str], url: str = "url", journal: str = "journal") -> DataFrame:
    """Drops rows whose URL or journal contains a banned text."""
    bad = F.lit(False)
    for b in banned:
        bad = bad | F.lower(F.coalesce(url, F.lit(""))).contains(b.lower()) | F.lower(F.coalesce(journal, F.lit(""))).contains(b.lower())
    return df.filter(~bad)


def drop_hosts(df: DataFrame, hosts: DataFrame, url: str = "url", host: str = "host") -> DataFrame:
    """Drops rows on an excluded host or below one.

    Every dot-suffix of a host is an equality key, so distinct hosts meet the
    list by an equality join, and rows the hosts that it holds by another;
    neither side is taken to be small.
    """
    own = df.select(N.host(url).alias("_h")).filter("_h is not null").distinct()
    parts = F.split("_h", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    listed = hosts.select(F.lower(host).alias("_s")).distinct()
    out = own.select("_h", F.explode(suffixes).alias("_s")).join(listed, "_s", "left_semi").select("_h").distinct()
    return df.join(out, N.host(url) == F.col("_h"), "left_anti")


def fresh(df: DataFrame, as_of: Column, days: int, at: str = "cached_at") -> DataFrame:
    """Rows not older than some days at ``as_of``."""
    return df.filter(F.col(at) >= as_of - F.expr(f"INTERVAL {days} DAYS"))


def per_group(df: DataFrame, group: str | list[str], order: Sequence[Column | str], most: int) -> DataFrame:
    """The first ``most`` rows of each group; Spark cuts groups before the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")
