"""The data source of recorded payloads: partitions, pushed filters, errors as rows."""

import json

from pyspark.sql import functions as F

from paperloom.sources import payloads


def folder(spark, tmp_path):
    rows = [("osf", i, json.dumps({"id": str(i), "year": str(2000 + i % 20)})) for i in range(40)] + [("figshare", i, json.dumps({"id": i, "year": 1990 + i})) for i in range(30)] + [("uci", 0, json.dumps({"id": "x", "title": "é漢"}))]
    payloads.write(spark.createDataFrame(rows, "source string, ord long, payload string").repartition(3, "ord"), f"{tmp_path}/p")
    payloads.register(spark)
    return f"{tmp_path}/p"


def test_rows_and_partitions(spark, tmp_path):
    df = spark.read.format("recorded_payloads").load(folder(spark, tmp_path))
    got = df.collect()
    assert len(got) == 71 and not [r for r in got if r.error]
    assert {r.year for r in got if r.source == "uci"} == {None} and json.loads(next(r.payload for r in got if r.source == "uci"))["title"] == "é漢"
    assert df.rdd.getNumPartitions() >= 5


def test_options_leave_out_folders_and_years(spark, tmp_path):
    path = folder(spark, tmp_path)
    one = payloads.read(spark, path, ["osf"], ["osf"], least=2010)
    assert sorted(r.ord for r in one.collect()) == [i for i in range(40) if i % 20 >= 10]
    whole = payloads.read(spark, path)
    assert one.rdd.getNumPartitions() < whole.rdd.getNumPartitions() and whole.count() == 71
    both = payloads.read(spark, path, honours=["osf", "uci"], least=2000, most=2004)
    assert {s: both.filter(F.col("source") == s).count() for s in ("osf", "figshare", "uci")} == {"osf": 10, "figshare": 30, "uci": 0}
    assert both.filter("year between 2000 and 2004").count() == 15
    # filters of one query do not reach the next on the same rows
    assert [whole.filter("source = 'osf'").count(), whole.count(), whole.filter("year > 2100").count(), whole.count()] == [40, 71, 0, 71]
    assert payloads.read(spark, path, []).count() == 0


def test_errors_are_rows(spark, tmp_path):
    path = folder(spark, tmp_path)
    broken = tmp_path / "p" / "source=osf" / "part-bad.txt"
    broken.write_text('{"ord": 1, "payload": "{}"}\n{"ord": \nnot json\n\n{"payload": "{}"}\n[1]\n')
    (tmp_path / "p" / "source=osf" / "part-bad.json.gz").write_bytes(b"not gzip")
    got = spark.read.format("recorded_payloads").load(path).filter("error is not null").collect()
    assert sorted(r.error for r in got) == ["not a payload: JSONDecodeError", "not a payload: JSONDecodeError", "not a payload: KeyError", "not a payload: TypeError", next(r.error for r in got if r.error.startswith("unreadable"))]
    assert spark.read.format("recorded_payloads").load(path).filter("source = 'figshare'").count() == 30


def test_an_empty_folder(spark, tmp_path):
    payloads.register(spark)
    assert spark.read.format("recorded_payloads").load(f"{tmp_path}/none").collect() == []
