"""Staged import of several data sets, each with its own gate and status."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .replaceable import ReplaceableTable


@dataclass(frozen=True)
class Stage:
    """A data set: how it is read, where it is kept, and the year it must hold."""

    name: str
    read: Callable[[], DataFrame]
    path: str
    year: int | None = None


def table(spark: SparkSession, s: Stage) -> ReplaceableTable:
    """The stage's kept table, a partition for each year."""
    return ReplaceableTable(spark, s.path, ["year"] if s.year is not None else [], "year" if s.year is not None else None, 1)


def _held(spark: SparkSession, s: Stage) -> bool:
    rows = table(spark, s).read(None if s.year is None else [str(s.year)])
    return rows is not None and not rows.isEmpty()


def run(spark: SparkSession, stages: Sequence[Stage]) -> DataFrame:
    """Imports what is missing; (name, state, rows, error) of every stage.

    A source is read once.  Years other than the source's stay; a stage that fails
    leaves the others alone and what it held before.  A source without rows, or
    without rows of the expected year, is a failure.
    """
    said = []
    for s in stages:
        try:
            if _held(spark, s):
                said.append((s.name, "held", None, None))
                continue
            kept = table(spark, s)
            before = kept.versions.current()
            now = kept.replace(s.read(), whole=True)
            new = kept.read([p for p, folder in now["parts"].items() if before.get("parts", {}).get(p) != folder])
            n = new.count()
            if not n or (s.year is not None and str(s.year) not in now["parts"]):
                kept.restore(before or {"parts": {}, "schema": now["schema"]})
                raise ValueError("the source is empty" if not n else f"the source has no rows of {s.year}")
            said.append((s.name, "imported", n, None))
        except Exception as e:  # noqa: BLE001 (any failure is this stage's status)
            said.append((s.name, "failed", None, str(e).splitlines()[0][:200]))
    return spark.createDataFrame(said, "name string, state string, rows long, error string")
