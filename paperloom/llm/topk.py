"""Exact top-k inner products by a three-phase uniform threshold.

Candidates are dealt into chunks and queries into blocks; a (chunk, block) pair
is one unit of work, so a fixed set of queries meets all rows without a cross
join and without any pair leaving its task.  Dimensions are split into
``PARTS``; a part's inner products are the local score list of its dimensions.

1. A unit computes the list of one part alone, units taking turns.  For each
   query the ``DEPTH`` times k best entries of that list are resolved to full
   scores.  The k-th best of all units' resolved scores is a safe cutoff: at least k
   candidates reach it.
2. The cutoff goes back to all units with its query.  A candidate whose every
   part scores under cutoff / PARTS cannot reach the cutoff, so the entries of
   all lists at or over that uniform threshold are sufficient.  A list none of
   whose entries can get there, by the lengths of its vectors, is not computed.
3. Only these entries are resolved: the parts that miss are computed pair by
   pair, or read where their list is at hand.  Those under the cutoff drop out,
   and the k best by (score, smaller id) remain.

Lists are computed twice and never stored: that is a product of small matrices,
while their entries are as many as pairs.

Components are floor(scale * x).  Products are exact integers: a unit computes
in float32 or float64 while its largest possible sum fits the mantissa, else in
whole numbers, and a score beyond 64 bits counts as the nearest 64-bit number.

Edge cases: a vector that is null or holds a null, NaN or infinite component
takes no part, nor does a row without an id.  Rows with one id are one vector
if alike, and a query never meets candidates of its own id.  A shorter vector
counts as padded with zeros.  Fewer candidates than k give that many rows; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import materialize

CHUNK_ROWS = 8192
QUERY_ROWS = 2048
PARTS = 2
#: Queries whose score matrix is held at once.
SLICE = 256
#: Entries of a local list that are resolved for the cutoff, as a multiple of k.
DEPTH = 8
#: Pairs that are resolved at a time.
PAIRS = 1 << 15


def _matrix(column: pa.Array, dims: int, scale: float) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())]))
    out = np.zeros((len(column), dims))
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = np.floor(scale * flat)
    return out


def _exact(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sides as numbers in which all sums of their products are exact."""
    top = max(float(np.abs(q).max(initial=0)), 1.0) * max(float(np.abs(c).max(initial=0)), 1.0) * max(q.shape[1], 1)
    if top < 2**24:
        return q.astype(np.float32), c.astype(np.float32)
    if top < 2**53:
        return q, c
    return tuple(np.array([[int(x) for x in r] for r in m], object).reshape(m.shape) for m in (q, c))


def _parts(dims: int) -> list[slice]:
    return [slice(dims * p // PARTS, dims * (p + 1) // PARTS) for p in range(PARTS)]


def _list(q: np.ndarray, c: np.ndarray, part: slice) -> np.ndarray:
    """The local scores of one part of the dimensions."""
    return q[:, part] @ c[:, part].T if part.stop > part.start else np.zeros((len(q), len(c)), q.dtype)


def _resolve(q: np.ndarray, c: np.ndarray, part: slice, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """The scores of one part for some pairs, in steps of bounded size."""
    out = np.zeros(len(row), q.dtype)
    for a in range(0, len(row), PAIRS):
        z = slice(a, a + PAIRS)
        out[z] = (q[row[z], part] * c[col[z], part]).sum(axis=1) if part.stop > part.start else 0
    return out


def _best(query: np.ndarray, cand: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best rows of each query, smaller ids first among equals."""
    order = np.lexsort((cand, -score.astype(np.float64) if score.dtype != object else np.array([-x for x in score], object), query)) if len(score) else np.zeros(0, np.int64)
    if score.dtype == object and len(score):
        order = np.array(sorted(range(len(score)), key=lambda i: (query[i], -score[i], cand[i])), np.int64)
    ranked = query[order]
    start = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
    place = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[place < k]


def _first(q: np.ndarray, c: np.ndarray, own: np.ndarray, k: int, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phase 1: the best entries of one list, resolved."""
    parts = _parts(q.shape[1])
    local = _list(q, c, parts[turn % PARTS])
    n = min(DEPTH * k + 1, len(c))  # one may be the query itself
    near = np.argpartition(-local, n - 1, axis=1)[:, :n]
    row, at = np.nonzero(~np.take_along_axis(own, near, axis=1))
    col = near[row, at]
    return row, col, local[row, col] + sum(_resolve(q, c, p, row, col) for i, p in enumerate(parts) if i != turn % PARTS)


def _sufficient(q: np.ndarray, c: np.ndarray, own: np.ndarray, cutoff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phases 2 and 3: the pairs that reach the cutoff, from the entries over the uniform threshold."""
    parts = _parts(q.shape[1])
    cutoff = cutoff.astype(object) if q.dtype == object else cutoff
    limit = (cutoff // PARTS)[:, None]  # rounded down, so nothing sufficient is lost
    lists: dict[int, np.ndarray] = {}
    hit = np.zeros((len(q), len(c)), bool)
    for i, p in enumerate(parts):
        length = lambda m: np.sqrt((m[:, p].astype(np.float64) ** 2).sum(axis=1)).max(initial=0)  # noqa: E731, B023
        if length(q) * length(c) * (1 + 1e-9) >= float(limit.min()):
            lists[i] = _list(q, c, p)
            hit |= lists[i] >= limit
    row, col = np.nonzero(hit & ~own)
    score = sum(lists[i][row, col] if i in lists else _resolve(q, c, p, row, col) for i, p in enumerate(parts))
    score = np.clip(score, -(2**63), 2**63 - 1) if q.dtype == object else score
    reach = score >= cutoff[row]
    return row[reach], col[reach], score[reach]


def _unit(q_ids, q, cutoff, c_ids, c, k, phase, turn):
    q, c = _exact(q, c)
    own = q_ids[:, None] == c_ids[None, :]
    row, col, score = _first(q, c, own, k, turn) if phase == 1 else _sufficient(q, c, own, cutoff)
    if score.dtype == object:
        score = np.clip(score, -(2**63), 2**63 - 1)
    keep = _best(row, c_ids[col], score, k)
    return q_ids[row[keep]], c_ids[col[keep]], score[keep].astype(np.int64)


def _search(units: DataFrame, dims: int, scale: float, k: int, phase: int) -> DataFrame:
    """Runs a phase over all units; the rows of a partition come sorted by unit, queries first."""

    def solve(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts).combine_chunks()
        n = int(pc.sum(t["is_query"]).as_py() or 0)
        turn = t["chunk"][0].as_py() + t["block"][0].as_py()
        ids, m = t["id"].to_numpy(), _matrix(t["v"].chunk(0), dims, scale)
        cutoff = pc.fill_null(t["cutoff"], -(2**63)).to_numpy()[:n]  # none: fewer than k candidates
        if 0 < n < len(ids):
            for a in range(0, n, SLICE):
                z = slice(a, min(n, a + SLICE))
                query, cand, score = _unit(ids[z], m[z], cutoff[z], ids[n:], m[n:], k, phase, turn)
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(cand), pa.array(score)], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            key = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
            cut = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for s, e in zip(cut, cut[1:]):
                if e > s:
                    if now != (at := tuple(key[s].tolist())):
                        if held:
                            yield from solve(held)
                        now, held = at, []
                    held.append(batch.slice(s, e - s))
        if held:
            yield from solve(held)

    return units.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query row."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), is_query.alias("ask")).filter("id is not null and v is not null").filter(~bad)
    rows = materialize(spark, rows.dropDuplicates(["id", "v"]), "vectors")
    n, asked, dims = rows.agg(F.count("*"), F.count_if("ask"), F.max(F.size("v"))).first()
    chunks, blocks = max(1, -(-n // CHUNK_ROWS)), max(1, -(-asked // QUERY_ROWS))
    deal = lambda many: F.pmod(F.xxhash64("id"), F.lit(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))

    def units(cutoffs: DataFrame | None) -> DataFrame:
        asks = rows.filter("ask")
        asks = asks.withColumn("cutoff", F.lit(None).cast("long")) if cutoffs is None else asks.join(cutoffs, asks["id"] == cutoffs["query_id"], "left")
        asks = asks.select(every(chunks).alias("chunk"), deal(blocks).alias("block"), F.lit(1).alias("is_query"), "id", "v", "cutoff")
        given = rows.select(deal(chunks).alias("chunk"), every(blocks).alias("block"), F.lit(0).alias("is_query"), "id", "v", F.lit(None).cast("long").alias("cutoff"))
        both = asks.unionByName(given)
        return both.repartition(chunks * blocks, "chunk", "block").sortWithinPartitions("chunk", "block", F.desc("is_query"), "id")

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    first = _search(units(None), dims or 0, scale, k, 1)
    cutoffs = first.withColumn("rank", rank).filter(F.col("rank") <= k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("cutoff"))
    cutoffs = materialize(spark, cutoffs, "cutoffs")
    found = _search(units(cutoffs), dims or 0, scale, k, 2)
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
