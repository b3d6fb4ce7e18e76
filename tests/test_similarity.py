"""Pruned similarity joins against all pairs."""

import random

import numpy as np
import pytest

from paperloom.operators import search, similarity
from paperloom.plans import registry

SCHEMA = "vec_id long, embedding array<float>"


def rows_of(seed, n, middles, spread, dims=8):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 3) for _ in range(dims)] for _ in range(middles)]
    return [(i, [np.float32(x + rng.gauss(0, spread)).item() for x in centre[rng.randrange(middles)]]) for i in range(n)]


def all_pairs(rows, threshold):
    out = {}
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            x, y = np.array(rows[a][1]), np.array(rows[b][1])
            if len(x) == len(y) and x.any() and y.any() and (c := x @ y / np.sqrt(x @ x) / np.sqrt(y @ y)) >= threshold and rows[a][0] != rows[b][0]:
                out[tuple(sorted((rows[a][0], rows[b][0])))] = c
    return out


def folded(rows, like):
    leaders, member = [], {}
    for i in sorted({i for i, _ in rows}):
        own = [a for a in leaders if (a, i) in like]
        if own:
            member[i] = own[0]
        else:
            leaders.append(i)
    return member


@pytest.fixture
def kept(spark):
    return lambda x: registry.stored(spark, x)


@pytest.mark.parametrize("threshold", [0.5, 0.9, 0.99])
def test_equal_to_all_pairs(spark, kept, monkeypatch, threshold):
    monkeypatch.setattr(similarity, "CHUNK_ROWS", 20)
    monkeypatch.setattr(similarity, "VISITORS", 150)
    rows = rows_of(1, 320, 9, 0.4) + [(400, [0.0] * 8), (401, [1.0, 2.0]), (402, [2.0, 4.0]), (403, None), (404, [float("nan")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    usable = [r for r in rows if r[0] is not None and r[1] is not None and r[0] != 404]
    want = all_pairs(usable, threshold)
    got = {(r.a, r.b): r.similarity for r in similarity.pairs(df, threshold, kept).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    groups = similarity.leaders(df, threshold, kept).collect()
    member = folded(usable, want)
    assert {r.member: r.leader for r in groups} == member and len(groups) == len(member)
    assert all(abs(r.similarity - want[r.leader, r.member]) < 1e-9 for r in groups)


def test_most_pairs_are_skipped(spark, kept, monkeypatch):
    """Clustered vectors at 0.97: a tenth of the pairs or fewer are compared; at 0.1 nearly all are."""
    monkeypatch.setattr(similarity, "CHUNK_ROWS", 32)
    rows = rows_of(2, 600, 20, 0.1)
    stored = kept(similarity._rows(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding").selectExpr("id", "v", "0 as state"))
    centres = search.ivf_fit(stored, id_col="id", vector="v", most=19).centres
    share = [similarity.compared(similarity.units(stored, t, centres)) / (600 * 599 / 2) for t in (0.97, 0.1)]
    print("share of pairs compared at 0.97 and 0.1:", share)
    assert share[0] < 0.2 < 0.6 < share[1] <= 1


def test_a_third_alike_and_a_chain(spark, kept):
    rng = random.Random(3)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 900, 3)] + [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(900) if i % 3]
    groups = {r.member: r.leader for r in similarity.leaders(spark.createDataFrame(rows, SCHEMA), 0.999, kept).collect()}
    assert all(groups[i] == 0 for i in range(3, 900, 3))
    angle = np.radians(20)
    chain = [(i, [float(np.cos(i * angle)), float(np.sin(i * angle))]) for i in range(9)]
    got = {r.member: r.leader for r in similarity.leaders(spark.createDataFrame(chain, SCHEMA), float(np.cos(angle)) - 1e-6, kept).collect()}
    assert got == {1: 0, 3: 2, 5: 4, 7: 6}


def test_edges(spark, kept):
    empty = spark.createDataFrame([], SCHEMA)
    assert similarity.pairs(empty, 0.5, kept).collect() == similarity.leaders(empty, 0.5, kept).collect() == []
    with pytest.raises(ValueError):
        similarity.pairs(empty, 0.0, kept)
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0])], SCHEMA)
    assert {(r.leader, r.member) for r in similarity.leaders(twice, 0.9, kept).collect()} == {(1, 2)}


def test_memory_of_placing_and_of_alike_vectors_is_bounded(spark):
    """Rows that visit all pivots are made in steps, and pairs that are all alike are summed in steps."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(4)
    vectors = np.abs(rng.normal(size=(4096, 32)))
    lists = pa.FixedSizeListArray.from_arrays(pa.array(vectors.ravel()), 32).cast(pa.list_(pa.float64()))
    ids, state = pa.array(np.arange(4096)), pa.array(np.zeros(4096, np.int32))
    rows = spark.createDataFrame([(i, vectors[i].tolist(), 0) for i in range(4096)], "id long, v array<double>, state int")

    class Seen:
        schema, runs = rows.schema, []

        def mapInArrow(self, run, schema):
            self.runs.append(run)
            if len(self.runs) == 2:
                raise InterruptedError
            return rows.mapInArrow(run, schema)

    with pytest.raises(InterruptedError):
        similarity.units(Seen(), 0.1, similarity._unit(vectors[:64]))
    batch = pa.RecordBatch.from_arrays([ids, lists, state], names=["id", "v", "state"])
    made = [len(x) for x in Seen.runs[1](iter([batch]))]
    assert max(made) <= 2 * similarity.PLACED and sum(made) > 3 * similarity.PLACED

    unit = pa.array(np.zeros(4096, np.int32))
    side = pa.array((np.arange(4096) >= 2048).astype(np.int32))
    met = pa.RecordBatch.from_arrays([unit, unit, unit, side, ids, lists, state], names=["c", "u", "s", "side", "id", "v", "state"])
    tracemalloc.start()
    told = sum(len(x) for x in similarity._told_of(0.1)(iter([met])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert told >= 4095 and peak < 150e6
