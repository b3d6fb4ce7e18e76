"""Exact similarity self-joins that skip what triangle inequalities rule out.

Unit vectors are placed at the nearest of some pivots.  Angles obey the triangle
inequality, so a vector whose angle to a pivot exceeds the pivot's radius by more
than the angle of the threshold is like none of its members: it is not sent there.
Each pivot's members are dealt into chunks that a task holds; vectors of earlier pivots
visit them in salted groups and are read in a stream, so no task's memory or work grows
with the table.  Pairs under the threshold never leave a task.

Groups are found without writing pairs: a task tells of each vector only whether an
earlier leader, or an earlier vector that is still open, is like it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import acos

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import search

#: Members of a chunk, and visitors that meet one chunk in one task.
CHUNK_ROWS, VISITORS = 4096, 1 << 16
#: Rows that a unit gathers before it joins them.
HELD = 1 << 17
#: Rows of a matrix product.
SLICE = 256
#: Rows that placing makes at once, and pairs whose exact cosines are taken at once.
PLACED, PAIRS = 1 << 15, 1 << 14
MOST_PIVOTS = 256
#: Slack of the bounds, in radians and in cosine.
TINY = 1e-6

_UNIT = ["c", "u", "s"]
Checkpoint = Callable[[DataFrame], DataFrame]


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-300)


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1)


def units(rows: DataFrame, threshold: float, centres: np.ndarray) -> DataFrame:
    """(c, u, s, side, id, v, state): members (side 0) and visitors (side 1) of each unit of work.

    ``rows`` are (id, v, state), written, of one dimension.
    """
    least = acos(max(-1.0, min(1.0, threshold))) + TINY

    def placed(radius: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # a row may visit every pivot, so a batch is taken in steps whose visits are bounded
            step = max(1, PLACED // len(centres))
            for batch in (b.slice(k, step) for b in batches for k in range(0, len(b), step)):
                angle = np.arccos(np.clip(_unit(_matrix(batch, "v")) @ centres.T, -1, 1))
                own = angle.argmin(axis=1)
                if radius is None:
                    yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(angle[np.arange(len(own)), own])], names=["c", "angle"])
                    continue
                visits = (angle - radius <= least) & (np.arange(len(centres)) > own[:, None])
                x, c = np.nonzero(visits)
                at = pa.array(np.concatenate([np.arange(len(own)), x]))
                side = np.concatenate([np.zeros(len(own), np.int32), np.ones(len(x), np.int32)])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([own, c]).astype(np.int32)), pa.array(side), *(batch.column(k).take(at) for k in ("id", "v", "state"))], names=["c", "side", "id", "v", "state"])

        return run

    sizes = rows.mapInArrow(placed(None), "c int, angle double").groupBy("c").agg(F.max("angle").alias("r"), F.count("*").alias("n")).collect()  # MOST_PIVOTS rows
    radius, chunks = np.full(len(centres), -np.inf), [1] * len(centres)
    for r in sizes:
        radius[r["c"]], chunks[r["c"]] = r["r"], -(-r["n"] // CHUNK_ROWS)
    salts = max(1, -(-sum(r["n"] for r in sizes) // VISITORS))
    kind = rows.schema["v"].dataType.simpleString()
    moved = rows.mapInArrow(placed(radius), f"c int, side int, id long, v {kind}, state int")
    many = F.element_at(F.array(*map(F.lit, chunks)), F.col("c") + 1)
    own, salt = F.pmod(F.xxhash64("id"), many).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(salts)).cast("int")
    moved = moved.withColumn("many", many).withColumn("own", own)
    home = moved.filter("side = 0").select("c", F.col("own").alias("u"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("s"), "side", "id", "v", "state")
    # members also visit the later chunks of their own pivot
    there = F.when(F.col("side") == 1, F.sequence(F.lit(0), F.col("many") - 1)).when(F.col("own") + 1 < F.col("many"), F.sequence(F.col("own") + 1, F.col("many") - 1))
    guests = moved.select("c", F.explode(there).alias("u"), salt.alias("s"), F.lit(1).alias("side"), "id", "v", "state")
    return home.unionByName(guests).repartition(*_UNIT).sortWithinPartitions(*_UNIT, "side", "id")


def compared(dealt: DataFrame) -> int:
    """How many pairs the units compare."""
    per = dealt.groupBy(*_UNIT).agg(F.count_if(F.col("side") == 0).alias("h"), F.count_if(F.col("side") == 1).alias("g"))
    inner = F.when(F.col("s") == 0, F.col("h") * (F.col("h") - 1) / 2).otherwise(0)
    return int(per.agg(F.sum(F.col("h") * F.col("g") + inner)).first()[0] or 0)


def _meet(batches: Iterator[pa.RecordBatch], threshold: float, told) -> Iterator[pa.RecordBatch]:
    """Calls ``told(unit, home, guests, x, y, cos)`` with the like pairs (x of home, y of guests) of each step, and ``told(unit, home, None, ...)`` at a unit's end."""

    def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        dot, p, q = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
        for k in range(a.shape[1]):  # summed in the order of the cosine expression
            dot += a[:, k] * b[:, k]
            p += a[:, k] * a[:, k]
            q += b[:, k] * b[:, k]
        both = np.sqrt(p) * np.sqrt(q)
        return np.divide(dot, both, out=np.zeros(len(a)), where=both > 0)

    def like(home, guest, same: bool) -> Iterator:
        for s in range(0, len(guest[0]), SLICE):
            part = tuple(z[s : s + SLICE] for z in guest)
            x, y = np.nonzero(home[3] @ part[3].T >= threshold - TINY)
            if same:
                x, y = x[x < y + s], y[x < y + s]
            cos = np.concatenate([np.zeros(0), *(exact(home[1][x[k : k + PAIRS]], part[1][y[k : k + PAIRS]]) for k in range(0, len(x), PAIRS))])
            x, y, cos = x[cos >= threshold], y[cos >= threshold], cos[cos >= threshold]
            if len(x):
                yield from told(home, part, x, y, cos)

    now, home = None, None
    for parts in _runs(batches):
        unit, side = parts[0], parts[1]
        rows = (parts[2], parts[3], parts[4], _unit(parts[3]))
        if unit != now:
            now, home = unit, None
        if side == 0:
            home = rows if home is None else tuple(np.concatenate([a, b]) for a, b in zip(home, rows))
            continue
        if home is not None:
            if side == 2:
                if unit[2] == 0:
                    yield from like(home, home, True)
            else:
                yield from like(home, rows, False)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(unit, side, ids, vectors, states) in order; side 2, without rows, follows a unit's members."""
    now, after = None, False
    for batch in batches:
        key = np.stack([batch.column(k).to_numpy() for k in (*_UNIT, "side")], axis=1)
        ids, m, state = batch.column("id").to_numpy(), _matrix(batch, "v"), batch.column("state").to_numpy()
        cut = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
        for s, e in zip(cut, cut[1:]):
            if e <= s:
                continue
            unit, side = tuple(key[s, :3].tolist()), int(key[s, 3])
            if not after and now is not None and (unit != now or side == 1):
                yield now, 2, ids[:0], m[:0], state[:0]
                after = True
            if unit != now:
                now, after = unit, side == 1
            yield unit, side, ids[s:e], m[s:e], state[s:e]
    if now is not None and not after:
        yield now, 2, np.zeros(0, np.int64), np.zeros((0, 1)), np.zeros(0, np.int32)


def _rows(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    v = F.col(vector)
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id is not null and size(v) > 0")
    return rows.filter(~bad).filter(F.exists("v", lambda x: x != 0))  # without length there is no likeness over 0


def _by_dimension(rows: DataFrame) -> Iterator[tuple[DataFrame, np.ndarray]]:
    """The rows of each dimension with their pivots; vectors of different dimensions are not like."""
    for r in rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect():  # a row for each dimension
        some = rows.filter(F.size("v") == r["d"])
        pivots = min(MOST_PIVOTS, -(-r["n"] // CHUNK_ROWS))
        centres = search.ivf_fit(some, id_col="id", vector="v", most=pivots).centres
        yield some, centres


def pairs(vectors: DataFrame, threshold: float, checkpoint: Checkpoint, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(a, b, similarity) of all pairs with a < b at or over a threshold over 0.

    A vector without an id or length, or with a null or non-finite component,
    is in no pair, nor are two rows of one id.
    """
    if threshold <= 0:
        raise ValueError("a threshold over 0, as nothing can be skipped at or below it")

    def told(home, part, x, y, cos) -> Iterator[pa.RecordBatch]:
        a, b = np.minimum(home[0][x], part[0][y]), np.maximum(home[0][x], part[0][y])
        keep = a != b
        yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(cos[keep])], names=["a", "b", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _meet(batches, threshold, told)

    rows = checkpoint(_rows(vectors, id_col, vector).withColumn("state", F.lit(0)))
    found = [units(some, threshold, centres).mapInArrow(run, "a long, b long, similarity double") for some, centres in _by_dimension(rows)]
    out = rows.sparkSession.createDataFrame([], "a long, b long, similarity double")
    for x in found:
        out = out.unionByName(x)
    return out


_OPEN, _LEADER, _MEMBER = 0, 1, 2


def _told_of(threshold: float):
    """Per unit of work, one row for each later vector that is open: its earliest leader, and whether it waits."""

    def told(home, part, x, y, cos) -> Iterator[pa.RecordBatch]:
        first, other = home[0][x], part[0][y]
        early, late = np.minimum(first, other), np.maximum(first, other)
        state = np.where(first < other, home[2][x], part[2][y])
        late_state = np.where(first < other, part[2][y], home[2][x])
        keep = (early != late) & (late_state != _LEADER) & (state != _MEMBER)
        early, late, state, cos = early[keep], late[keep], state[keep], cos[keep]
        led = state == _LEADER
        yield _joined(late, early, led, cos, ~led)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        unit: list[np.ndarray] = [np.zeros(0)]

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            led = t["leader"].is_valid().to_numpy()
            return _joined(t["id"].to_numpy(), t["leader"].fill_null(0).to_numpy(), led, t["similarity"].fill_null(0).to_numpy(), t["waits"].to_numpy())

        def gathered(home, part, x, y, cos) -> Iterator[pa.RecordBatch]:
            if held and (unit[0] is not home[0] or sum(map(len, held)) > HELD):
                yield out()
                held.clear()
            unit[0] = home[0]
            held.extend(told(home, part, x, y, cos))

        yield from _meet(batches, threshold, gathered)
        if held:
            yield out()

    return run


def _joined(ids: np.ndarray, leader: np.ndarray, led: np.ndarray, cos: np.ndarray, waits: np.ndarray) -> pa.RecordBatch:
    """One row for each id: its earliest leader if it has any, and whether it waits for an open vector."""
    order = np.lexsort((leader, ~led, ids))
    own, at = np.unique(ids[order], return_index=True)
    best = order[at]
    waiting = np.bincount(np.searchsorted(own, ids), waits, len(own)) > 0
    return pa.RecordBatch.from_arrays([pa.array(own), pa.array(leader[best], mask=~led[best]), pa.array(cos[best], mask=~led[best]), pa.array(waiting)], names=["id", "leader", "similarity", "waits"])


def _heard(rows: DataFrame, threshold: float, centres: np.ndarray) -> DataFrame:
    """(id, x, waits): for vectors that are like an earlier leader or open vector, the earliest leader with its similarity."""
    found = units(rows, threshold, centres).mapInArrow(_told_of(threshold), "id long, leader long, similarity double, waits boolean")
    return found.groupBy("id").agg(F.min(F.when(F.col("leader").isNotNull(), F.struct("leader", "similarity"))).alias("x"), F.max("waits").alias("waits"))


def leaders(vectors: DataFrame, threshold: float, checkpoint: Checkpoint, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(leader, member, similarity): greedy groups in id order.

    A vector leads if no earlier leader is like it, else it joins the earliest such leader.
    Each round decides all whose earlier neighbours are decided: rounds
    grow with the longest chain of rising ids, and no round writes a pair.  Rows
    with the same vector are one, the smallest id for all; copies join its leader, or itself.
    """
    rows = checkpoint(_rows(vectors, id_col, vector))
    classes = checkpoint(rows.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    # an id stands for one vector: its rows' first
    own = checkpoint(classes.groupBy("id").agg(F.min("v").alias("v")))
    led = rows.sparkSession.createDataFrame([], "leader long, member long, similarity double")
    for some, centres in _by_dimension(own):
        now = checkpoint(some.select("id", "v", F.lit(_OPEN).alias("state")))
        lead = member = None
        while not now.isEmpty():
            told = _heard(now, threshold, centres)
            state = F.when(F.col("x").isNotNull(), _MEMBER).when(F.col("waits"), _OPEN).otherwise(_LEADER)
            decided = checkpoint(now.filter(F.col("state") == _OPEN).join(told, "id", "left").select("id", "v", state.alias("state")))
            fresh = decided.filter(F.col("state") == _LEADER)
            lead = fresh if lead is None else lead.unionByName(fresh)
            gone = decided.filter(F.col("state") == _MEMBER)
            member = gone if member is None else member.unionByName(gone)
            open_ = decided.filter(F.col("state") == _OPEN)
            if open_.isEmpty():
                break
            now = checkpoint(decided.filter(F.col("state") != _MEMBER))
        if member is not None:
            last = _heard(checkpoint(lead.unionByName(member)), threshold, centres).filter("x is not null")
            led = led.unionByName(last.select(F.col("x.leader").alias("leader"), F.col("id").alias("member"), F.col("x.similarity").alias("similarity")))
    led = checkpoint(led)
    twins = rows.join(classes.filter("n > 1").select("v", F.col("id").alias("first")), "v").filter("id <> first")
    joined = twins.select(F.col("id").alias("copy"), "first").join(led, F.col("first") == F.col("member"), "left")
    return led.unionByName(joined.select(F.coalesce("leader", "first").alias("leader"), F.col("copy").alias("member"), F.coalesce("similarity", F.lit(1.0)).alias("similarity")))
