"""The stored vector index: recall after changes, folders read, headers refused."""

import random

import numpy as np
import pytest

from paperloom.operators import vectorstore
from paperloom.operators.vectorstore import BadHeader, VectorStore

SCHEMA = "vec_id long, embedding array<float>"


def made(seed, ids, middles=12, dims=8):
    rng = random.Random(seed)
    centre = [[random.Random(f"{c}").gauss(0, 3)] * 0 + [random.Random(f"{c}-{j}").gauss(0, 3) for j in range(dims)] for c in range(middles)]
    return [(i, [x + rng.gauss(0, 1) for x in centre[i % middles]]) for i in ids]


def recall(store, live, asked, k=10):
    ids, m = np.array([i for i, _ in live]), np.array([v for _, v in live])
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    found, hits = {}, 0
    for r in store:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    for i, v in asked:
        cos = unit @ (np.array(v) / np.linalg.norm(v))
        cos[ids == i] = -2
        hits += len(found.get(i, set()) & set(ids[np.argsort(-cos)[:k]].tolist()))
    return hits / (k * len(asked))


def test_recall_after_adds_and_removes(spark, tmp_path):
    rows = made(1, range(1500))
    store = VectorStore(spark, str(tmp_path / "v")).build(spark.createDataFrame(rows, SCHEMA), "m")
    store.add(spark.createDataFrame(made(2, range(1400, 1900)), SCHEMA))
    store.remove(spark.createDataFrame([(i,) for i in range(0, 1900, 7)], "vec_id long"))
    live = {i: v for i, v in rows} | {i: v for i, v in made(2, range(1400, 1900))}
    live = [(i, v) for i, v in live.items() if i % 7]
    assert store.versions.current()["count"] == len(live) == store.rows().count()
    asked = [x for x in live if x[0] % 20 == 1]
    found = store.open("m", 8).search(spark.createDataFrame(asked, SCHEMA), 10).collect()
    assert recall(found, live, asked) >= 0.9
    assert all(r.vec_id % 7 for r in found)
    first = store.versions.current()
    store.compact()
    assert store.open("m", 8).versions.current()["count"] == first["count"] and not store.versions.current()["gone"]
    again = store.search(spark.createDataFrame(asked, SCHEMA), 10).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))


def test_a_search_reads_the_probed_folders_alone(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "v")).build(spark.createDataFrame(made(3, range(1200)), SCHEMA), "m")
    assert store.versions.current()["clusters"] == 120
    rows = store.rows([3, 5])
    read = {r.f.rsplit("/", 2)[1] for r in rows.selectExpr("input_file_name() as f").distinct().collect()}
    assert read <= {"c=3", "c=5"} and read
    assert "PartitionFilters: [c" in rows._jdf.queryExecution().executedPlan().toString()
    one = spark.createDataFrame(made(4, [5000]), SCHEMA)
    assert store.search(one, 5, probes=2).count() == 5


def test_headers_are_refused(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "v"))
    with pytest.raises(BadHeader):
        store.open("m")
    with pytest.raises(BadHeader):
        store.add(spark.createDataFrame(made(1, [1]), SCHEMA))
    store.build(spark.createDataFrame(made(1, range(50)), SCHEMA), "m")
    assert store.valid("m", 8)
    assert not store.valid("other") and not store.valid("m", 9)
    with pytest.raises(BadHeader):
        store.add(spark.createDataFrame([(99, [1.0, 2.0])], SCHEMA))
    assert store.valid("m", 8)  # nothing of the refused change counts
    now = {k: v for k, v in store.versions.current().items() if k != "version"}
    store.versions.commit(now | {"count": 51}, store.versions.begin(), store.versions.current()["version"])
    assert not store.valid("m", 8)


def test_edges(spark, tmp_path, monkeypatch):
    store = VectorStore(spark, str(tmp_path / "v")).build(spark.createDataFrame([], SCHEMA), "m")
    assert store.valid("m") and store.search(spark.createDataFrame(made(1, [1]), SCHEMA), 3).collect() == []
    rows = made(1, range(30)) + [(3, [9.0] * 8), (None, [1.0] * 8), (40, None), (41, [float("nan")] * 8)]
    store.build(spark.createDataFrame(rows, SCHEMA), "m")
    assert store.versions.current()["count"] == 30
    monkeypatch.setattr(vectorstore, "MOST_SEGMENTS", 2)
    for n in range(3):
        store.add(spark.createDataFrame(made(n, range(5)), SCHEMA))
    assert len(store.versions.current()["segments"]) <= 2 and store.valid("m", 8)
