"""Streams with state: buffered usage, keyed merges, repeated and failed batches."""

import datetime as dt

import pytest

from paperloom.sources.replaceable import ReplaceableTable
from paperloom.streaming import feeds

START = dt.datetime(2024, 1, 1)
EVENTS = "k string, ts timestamp, v double"


def drive(spark, tmp_path, batches):
    """The flushes of a stream that is stopped and started again after each batch."""
    for rows in batches:
        data = [(k, START + dt.timedelta(seconds=s), v) for k, s, v in rows]
        spark.createDataFrame(data, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = feeds.flushed(spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in"), "k", "ts", "v", rows=3, seconds=5, late="2 seconds")
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ckpt").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out").collect()
    return sorted((r.key, r.flush, r.n, r.total, (r.first - START).total_seconds(), (r.last - START).total_seconds(), r.reason) for r in found)


def test_buffers_flush_by_count_and_by_time(spark, tmp_path):
    got = drive(spark, tmp_path, [
        [("a", 0, 1.0), ("a", 1, 2.0), ("a", 2, 4.0), ("a", 3, 8.0), ("b", 0, None)],
        [("a", 4, 16.0), ("b", 20, 1.0)],
        [("a", 6, 99.0), ("c", 40, 5.0)],
    ])
    assert got == [
        ("a", 0, 3, 7.0, 0.0, 2.0, "count"),
        ("a", 1, 2, 24.0, 3.0, 4.0, "time"),  # the event at 6 came after the watermark had passed it
        ("b", 0, 1, 0.0, 0.0, 0.0, "time"),
        ("b", 1, 1, 1.0, 20.0, 20.0, "time"),
    ]


def test_retention(spark):
    usage = spark.createDataFrame([("2024-01-01", 1), ("2024-06-29", 2), (None, 3), ("2024-01-03", 4), ("2024-01-02", 5)], "day string, n int")
    assert {r.n for r in feeds.retained(usage, "day", "2024-06-30").collect()} == {2, 4}


BATCH = "ord long, doi string, title string, citations long, sources array<string>, search_id string"


def test_merges_touch_their_keys_and_survive_failures(spark, tmp_path):
    table = feeds.merged_table(spark, f"{tmp_path}/m", 8)
    frame = lambda rows: spark.createDataFrame(rows, BATCH)
    first = frame([(i, f"10.1/{i}", "t", i, ["a"], "now") for i in range(40)] + [(100, None, "none", 1, ["a"], "now"), (0, "10.1/1", "t", 10**6, ["x"], "old")])
    second = frame([(200, "https://doi.org/10.1/3", "longer title", 1, ["b"], "now"), (201, None, "none", 2, ["b"], "now")])
    step = feeds.progressive_merge(table, "now")
    step(first, 0)
    before = table.versions.current()["parts"]

    class Broken(ReplaceableTable):
        def _write(self, rows, path):
            super()._write(rows.limit(1), path)
            raise OSError("lost")

    with pytest.raises(OSError):
        feeds.progressive_merge(Broken(spark, table.path, ["key"], folders=8), "now")(second, 1)
    assert table.read().count() == 41
    step(second, 1)
    after = table.versions.current()["parts"]
    assert sum(before[p] != after[p] for p in before) <= 2  # the folders of two keys
    once = sorted(map(tuple, table.read().select("ord", "title", "citations", "sources").collect()))
    step(second, 1)  # the same batch again
    assert sorted(map(tuple, table.read().select("ord", "title", "citations", "sources").collect())) == once
    rows = {r.ord: (r.title, r.citations, sorted(r.sources)) for r in table.read().collect()}
    assert rows[3] == ("longer title", 3, ["a", "b"]) and len(rows) == 42 and rows[1][1] == 1
