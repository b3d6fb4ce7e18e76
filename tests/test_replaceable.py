"""Partitions replaced as a whole, failures half-way, several tables together."""

import pytest

from paperloom.sources import staged
from paperloom.sources.replaceable import ReplaceableTable, replace_together

CHUNK = "item long, model string, chunk int, text string"


class Broken(ReplaceableTable):
    """Dies after part of the files are written."""

    def _write(self, rows, path):
        super()._write(rows.limit(1), path)
        raise OSError("disk full")


def rows_of(table):
    rows = table.read()
    return None if rows is None else sorted(map(tuple, rows.collect()), key=str)


def test_groups_are_replaced_whole(spark, tmp_path):
    table = ReplaceableTable(spark, f"{tmp_path}/t", ["item", "model"], folders=4)
    assert table.read() is None
    first = [(i, m, c, f"{i}{m}{c}") for i in range(20) for m in ("a", "b") for c in range(3)] + [(None, "a", 0, "none")]
    table.replace(spark.createDataFrame(first, CHUNK))
    assert rows_of(table) == sorted(first, key=str)
    new = [(3, "a", 0, "new"), (99, "b", 0, "more"), (None, "a", 5, "other")]
    table.replace(spark.createDataFrame(new, CHUNK))
    want = [r for r in first if (r[0], r[1]) not in {(3, "a"), (None, "a")}] + new
    assert rows_of(table) == sorted(want, key=str)
    table.delete(spark.createDataFrame([(3, "a"), (5, "b"), (1000, "b")], "item long, model string"))
    want = [r for r in want if (r[0], r[1]) not in {(3, "a"), (5, "b")}]
    assert rows_of(table) == sorted(want, key=str)
    table.replace(spark.createDataFrame(want, CHUNK))
    assert table.vacuum() > 0 and rows_of(table) == sorted(want, key=str) and table.vacuum() == 0


def test_a_failed_write_leaves_the_old_rows(spark, tmp_path):
    table = ReplaceableTable(spark, f"{tmp_path}/t", ["item"], folders=3)
    first = spark.createDataFrame([(i, "a", 0, "old") for i in range(9)], CHUNK)
    table.replace(first)
    before = table.versions.current()
    with pytest.raises(OSError):
        Broken(spark, f"{tmp_path}/t", ["item"], folders=3).replace(spark.createDataFrame([(1, "a", 0, "new"), (2, "a", 0, "new")], CHUNK))
    assert table.versions.current() == before and rows_of(table) == sorted(map(tuple, first.collect()), key=str) and table.versions.pending()


def test_several_tables_or_none(spark, tmp_path):
    chunks, vectors = ReplaceableTable(spark, f"{tmp_path}/c", ["item"], folders=2), Broken(spark, f"{tmp_path}/v", ["item"], folders=2)
    old = spark.createDataFrame([(1, "a", 0, "old"), (2, "a", 0, "old")], CHUNK)
    chunks.replace(old)
    new = spark.createDataFrame([(1, "a", 0, "new")], CHUNK)
    with pytest.raises(OSError):
        replace_together([(chunks, new), (vectors, new)])
    assert rows_of(chunks) == [(1, "a", 0, "old"), (2, "a", 0, "old")] and vectors.read() is None
    fresh = ReplaceableTable(spark, f"{tmp_path}/f", ["item"], folders=2)
    with pytest.raises(OSError):
        replace_together([(fresh, new), (vectors, new)])
    assert rows_of(fresh) == []
    replace_together([(chunks, new), (fresh, new)])
    assert rows_of(chunks) == [(1, "a", 0, "new"), (2, "a", 0, "old")] and rows_of(fresh) == [(1, "a", 0, "new")]


def test_imports_keep_other_years(spark, tmp_path):
    path, read = f"{tmp_path}/m", []
    frame = lambda *rows: spark.createDataFrame(list(rows), "year int, v string")

    def source(*rows):
        def give():
            read.append(1)
            return frame(*rows)

        return give

    state = lambda year, give: [(r.state, r.rows) for r in staged.run(spark, [staged.Stage("m", give, path, year)]).collect()]
    table = staged.table(spark, staged.Stage("m", None, path, 2024))
    assert state(2024, source((2024, "a"), (2024, "b"))) == [("imported", 2)]
    assert state(2025, source((2025, "c"))) == [("imported", 1)] and rows_of(table) == [(2024, "a"), (2024, "b"), (2025, "c")]
    assert state(2025, source((2025, "x"))) == [("held", None)] and len(read) == 2
    assert state(2026, source((2023, "x"))) == [("failed", None)] and rows_of(table) == [(2024, "a"), (2024, "b"), (2025, "c")]
    assert state(2026, source()) == [("failed", None)] and rows_of(table) == [(2024, "a"), (2024, "b"), (2025, "c")]
    assert state(2026, source((2026, "z"), (None, "n"))) == [("imported", 2)] and len(rows_of(table)) == 5
    assert table.read(["2025"]).collect()[0].v == "c"
