"""The kept text index against a scan of all texts, through changes, drift and failed writes."""

import math
import random

import pytest

from paperloom.functions import text as X
from paperloom.operators import search, textindex
from paperloom.sources.shared import Conflict, Versions

WORDS = ["the", "of", "trash", "graph", "学习", "图", "Ab", "x1", "é"]


def docs(spark, seed, ids):
    rng = random.Random(seed)
    rows = [(i, None if i % 17 == 3 else " ".join(rng.choice(WORDS) for _ in range(rng.randrange(30)))) for i in ids]
    return spark.createDataFrame(rows, "doc_id long, text string")


def scan(df, query, k=50):
    return [(r.doc_id, round(r.score, 6)) for r in search.bm25(df, query, k).collect()]


def asked(index, query, k=50):
    return [(r.id, round(r.score, 6)) for r in index.bm25(query, k).collect()]


@pytest.fixture
def path(spark, tmp_path):
    return str(tmp_path / "index")


def plain(rows, query, k=50):
    """BM25 as stated, over (id, tokens or None)."""
    n, sizes = len(rows), [len(t) for _, t in rows if t is not None]
    mean, out = sum(sizes) / len(sizes), []
    for i, t in rows:
        score = 0.0
        for q in query:
            f, df = (t or []).count(q), sum(q in (x or []) for _, x in rows)
            if f:
                idf = math.log((n - df + 0.5) / (df + 0.5))
                score += (idf if idf > 0 else 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(t) / mean))
        if score:
            out.append((-round(score, 9), i))
    return [(i, round(-s, 6)) for s, i in sorted(out)[:k]]


def tokens_of(df):
    return [(r.doc_id, r.t) for r in df.select("doc_id", X.tokens("text").alias("t")).collect()]


def test_changes_equal_a_fresh_scan(spark, path):
    first, second = docs(spark, 1, range(60)), docs(spark, 2, range(40, 90))
    index = textindex.TextIndex(spark, path).build(first)
    query = ["the", "trash", "图", "学习", "the", "nowhere"]
    assert asked(index, query) == plain(tokens_of(first), query)
    index.add(second)
    now = first.join(second, "doc_id", "left_anti").unionByName(second)
    assert asked(index, query) == plain(tokens_of(now), query) and not index.drift(now)
    gone = now.filter("doc_id % 5 = 0")
    index.remove(gone)
    now = now.join(gone, "doc_id", "left_anti")
    assert asked(index, query) == plain(tokens_of(now), query) and not index.drift(now)
    before = index.versions.current()
    index.compact()
    after = index.versions.current()
    assert asked(index, query) == plain(tokens_of(now), query) and not index.drift(now)
    assert len(before["segments"]) == 3 and len(after["segments"]) == 1 and not after["gone"]
    assert (before["rows"], before["words"], before["texts"]) == (after["rows"], after["words"], after["texts"]) == (len(tokens_of(now)), sum(len(t) for _, t in tokens_of(now) if t is not None), sum(t is not None for _, t in tokens_of(now)))


def test_many_changes_are_compacted(spark, path, monkeypatch):
    monkeypatch.setattr(textindex, "MOST_SEGMENTS", 2)
    index = textindex.TextIndex(spark, path).build(docs(spark, 1, range(9)))
    for n in range(4):
        index.add(docs(spark, n, range(n, n + 4)))
    assert len(index.versions.current()["segments"]) <= 2 and index.lengths().count() == 9


def test_drift_and_rebuild(spark, path):
    """A missing index, another count, another largest id, other files or a failed write: the index is built anew."""
    index, table = textindex.TextIndex(spark, path), docs(spark, 1, range(20))
    assert index.drift(table).reasons == ("no index",)
    index.ensure(table, stamp="a")
    first = index.versions.current()
    assert not index.drift(table, stamp="a") and index.ensure(table, stamp="a").versions.current() == first
    assert index.drift(table, stamp="b").reasons == ("other files",)
    assert index.drift(docs(spark, 1, range(21)), stamp="a").reasons == ("count", "largest id")
    assert index.drift(docs(spark, 1, [*range(19), 40]), stamp="a").reasons == ("largest id",)

    class Broken(textindex.TextIndex):
        def _write(self, packs, segment, folders, words):
            raise OSError("disk full")

    with pytest.raises(OSError):
        Broken(spark, path).add(docs(spark, 3, range(30, 35)))
    # readers see the old index as a whole; the mark of the failed write tells that it lacks rows
    assert asked(index, ["the"]) == plain(tokens_of(table), ["the"])
    assert index.drift(table, stamp="a").reasons == ("failed write",)
    index.ensure(table, stamp="a")
    assert not index.drift(table, stamp="a") and index.versions.current()["version"] > first["version"]


def test_a_search_reads_its_terms_folders_alone(spark, path):
    index = textindex.TextIndex(spark, path).build(docs(spark, 1, range(80)))
    rows = index.postings(["trash"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "IsNotNull(term), EqualTo(term,trash)" in plan
    assert len({f.rsplit("/", 2)[1] for f in rows.inputFiles()}) <= len({f.rsplit("/", 2)[1] for f in index.postings().inputFiles()})
    read = {r.f.rsplit("/", 2)[1] for r in rows.selectExpr("input_file_name() as f").distinct().collect()}
    assert len(read) == 1


def test_edges(spark, path):
    index = textindex.TextIndex(spark, path)
    with pytest.raises(ValueError):
        index.add(docs(spark, 1, range(3)))
    empty = spark.createDataFrame([], "doc_id long, text string")
    index.ensure(empty)
    assert index.bm25(["the"], 5).collect() == [] and not index.drift(empty)
    rows = spark.createDataFrame([(1, "the"), (1, "of of"), (None, "the"), (2, None), (3, "")], "doc_id long, text string")
    index.build(rows)
    assert index.versions.current()["rows"] == 3 and index.lengths().count() == 3
    assert index.bm25([], 5).collect() == []


def test_two_writers_of_one_version(spark, path):
    a, b = Versions(spark, path), Versions(spark, path)
    one, two = a.begin(), b.begin()
    a.commit({"x": 1}, one, 0)
    with pytest.raises(Conflict):
        b.commit({"x": 2}, two, 0)
    assert a.current() == {"x": 1, "version": 1} and b.pending() == [two]
    a.folder.create("manifests/00000002.json", '{"x": ')  # a writer died
    assert a.current() == {"x": 1, "version": 1}
    assert a.commit({"x": 3}, a.begin(), 1) == {"x": 3, "version": 3} == b.current()


def test_memory_of_postings_is_bounded_by_tokens():
    """A batch of long texts is counted in parts, whose postings are those of the whole."""
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(8)
    words = [f"w{i}" for i in range(50)]
    tokens = [rng.choices(words, k=k) for k in [3000] * 1200 + [0, 1]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1203)), pa.array([*tokens, None], pa.list_(pa.string()))], names=["id", "tokens"])

    class Rows:
        def mapInArrow(self, run, schema):
            return run

    run = textindex._counted(Rows(), 8)
    tracemalloc.start()
    packs = list(run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = sorted(r for x in packs for cell in x["pack"] for rows in pa.ipc.open_stream(cell.as_buffer()) for r in zip(*(c.to_pylist() for c in rows.columns)))
    assert got == sorted((t, i, own.count(t), len(own)) for i, own in enumerate(tokens) for t in set(own))
    assert len(packs) > 1 and peak < 80e6
