"""Structured Streaming: progressive merges, usage windows, deletes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import normalize as N
from ..operators import dedup, mutation
from ..sources.replaceable import ReplaceableTable


def files(spark: SparkSession, path: str, schema: str, per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def daily_usage(events: DataFrame, at: str = "ts", measure: str = "value", late: str = "1 day") -> DataFrame:
    """Counts and totals of each day; rows later than ``late`` are left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum(measure).alias("total")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def run(stream: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None]) -> None:
    """Process what there is, batch by batch, and stop."""
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class Snapshots:
    """Versions of a table in one folder; a batch writes the next version once.

    A batch that is run again after a failure writes the same version again, so
    merges are exactly-once without a table format.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root, schema

    def read(self, version: int) -> DataFrame:
        if version < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/v={version}")

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/v={version}")


#: Folders of a merged table; a batch rewrites those that its keys lie in.
FOLDERS = 64


def merged_table(spark: SparkSession, path: str, folders: int = FOLDERS) -> ReplaceableTable:
    """Articles by their key (a DOI, or the row's own place), dealt into folders."""
    return ReplaceableTable(spark, path, ["key"], folders=folders)


def progressive_merge(table: ReplaceableTable, search_id: str) -> Callable[[DataFrame, int], None]:
    """Merges batches of results by DOI in arrival order; other searches' batches are dropped.

    A batch reads and replaces the rows of its own keys, so its work follows the
    batch and the folders that it touches.  Merging the same batch again changes
    nothing, so one that is run again after a failure does no harm; readers see a
    batch as a whole or not at all.
    """

    def step(batch: DataFrame, n: int) -> None:
        key = F.coalesce(N.doi("doi"), F.concat(F.lit("row:"), F.col("ord").cast("string")))
        now = batch.filter(F.col("search_id") == search_id).select("ord", "doi", "title", "citations", "sources", key.alias("key"))
        held = table.read()
        if held is not None:
            parts = [r[0] for r in now.select(F.pmod(F.xxhash64("key"), F.lit(table.folders)).cast("string")).distinct().collect()]  # folders at most
            now = table.read(parts).join(now.select("key").distinct(), "key", "left_semi").select(now.columns).unionByName(now)
        merged = dedup.merge_articles(now, F.col("key"), fill=["doi", "key"], long=["title"], most=["citations"], least=[])
        table.replace(merged.select("ord", "doi", "title", "citations", "sources", "key"))

    return step


FLUSH_ROWS, FLUSH_SECONDS, KEEP_DAYS = 30, 5, 180


def flushed(events: DataFrame, key: str, at: str, measure: str, rows: int = FLUSH_ROWS, seconds: int = FLUSH_SECONDS, late: str = "10 seconds") -> DataFrame:
    """(key, flush, n, total, first, last, reason): usage buffered by key, written out by count or by time.

    A buffer is flushed when it holds ``rows`` events, or when the watermark passes its
    first event by ``seconds``; its state is then gone but for the number of
    its next flush.  Events behind the watermark are left out; null measures count as 0.
    The last, unfinished buffers stay in the state until the watermark moves on.
    """

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flush, n, total, first, last = state.get if state.exists else (0, 0, 0.0, 0, 0)
        out: list[tuple[Any, ...]] = []

        def write(reason: str) -> None:
            nonlocal flush, n, total, first, last
            out.append((name[0], flush, n, total, pd.Timestamp(first, unit="us"), pd.Timestamp(last, unit="us"), reason))
            flush, n, total, first, last = flush + 1, 0, 0.0, 0, 0

        if state.hasTimedOut:
            if n:
                write("time")
        else:
            found = pd.concat(list(frames)).sort_values("at", kind="stable")
            for when, value in zip(found["at"].astype("datetime64[us]").astype("int64"), found["measure"]):
                if n and when - first >= seconds * 1_000_000:
                    write("time")
                if not n:
                    first = when
                n, total, last = n + 1, total + (0.0 if pd.isna(value) else float(value)), when
                if n >= rows:
                    write("count")
        state.update((flush, n, total, int(first), int(last)))
        if n:
            state.setTimeoutTimestamp(max(int(first) // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "flush", "n", "total", "first", "last", "reason"])

    kind = events.schema[key].dataType.simpleString()
    rows_in = events.withWatermark(at, late).select(F.col(key).alias("key"), F.col(at).alias("at"), F.col(measure).cast("double").alias("measure"))
    return rows_in.groupBy("key").applyInPandasWithState(step, f"key {kind}, flush long, n long, total double, first timestamp, last timestamp, reason string", "flush long, n long, total double, first long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def retained(usage: DataFrame, day: str, as_of: str, days: int = KEEP_DAYS) -> DataFrame:
    """Usage of the last ``days`` days; rows without a day go."""
    return usage.filter(F.col(day).cast("date") > F.date_sub(F.lit(as_of).cast("date"), days))


def cascade_deletes(table: Snapshots, first: DataFrame, key: str) -> Callable[[DataFrame, int], None]:
    """Takes deleted keys out of an index, batch by batch."""

    def step(batch: DataFrame, n: int) -> None:
        table.write(mutation.delete(first if n == 0 else table.read(n - 1), batch, [key]), n)

    return step


def upserts(table: Snapshots, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    def step(batch: DataFrame, n: int) -> None:
        table.write(mutation.upsert(table.read(n - 1), batch, keys, order), n)

    return step
