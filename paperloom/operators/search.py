"""Retrieval: cosine search, inverted-file search, BM25, duplicate groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import token_count, token_times

K1, B = 1.2, 0.75
#: Inverse document frequency of a term in half of all documents or more.
LEAST_IDF = 1e-6
#: Vectors of one side of a unit of comparisons, and those compared at once.
CHUNK_ROWS = 4096
SLICE = 256


def nearest(vectors: DataFrame, query: Sequence[float], k: int, id_col: str = "vec_id", vector: str = "embedding", threshold: float | None = None) -> DataFrame:
    """The k rows of largest cosine to one query vector; ties to the smaller id.

    Each Arrow batch is one matrix product and passes on its k best rows, with
    all that equal the last of them.  A vector without length, of another length
    than the query, or with a null has the similarity 0.
    """
    q = np.array(list(query), np.float64)
    q = q / max(float(np.linalg.norm(q)), 1e-300)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cos, column = np.zeros(len(batch)), batch.column(1)
            good = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), len(q)), False).to_numpy(zero_copy_only=False))
            if len(good) and len(q):
                m = column.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(good), len(q))
                norm = np.sqrt((m * m).sum(axis=1))
                value = np.divide(m @ q, norm, out=np.zeros(len(good)), where=norm > 0)
                cos[good] = np.where(np.isnan(value), 0.0, value)
            keep = cos >= (threshold if threshold is not None else -np.inf)
            if keep.sum() > k:
                keep &= cos >= -np.partition(-cos[keep], k - 1)[k - 1]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), pa.array(cos[keep])], names=["id", "similarity"])

    schema = T.StructType([T.StructField("id", vectors.schema[id_col].dataType), T.StructField("similarity", T.DoubleType())])
    scored = vectors.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, schema)
    return scored.select(F.col("id").alias(id_col), "similarity").orderBy(F.desc("similarity"), id_col).limit(k)


def bm25(docs: DataFrame, query: Sequence[str], k: int, id_col: str = "doc_id", text: str = "text", stored: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """BM25 of a bag of query terms, best first; repeated terms count twice.

    Only query terms are counted in each document, by patterns on its text, so
    no token list is made and no posting list is shuffled: a row for each
    document, and one row of totals joined back.
    """
    terms = list(dict.fromkeys(query))
    counted = docs.select(id_col, token_count(text).alias("_len"), *(token_times(text, term).alias(f"_f{i}") for i, term in enumerate(terms)))
    if stored is not None:  # counted once for the totals and the scores
        counted = stored(counted)
    totals = counted.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *(F.count_if(F.col(f"_f{i}") > 0).alias(f"_n{i}") for i in range(len(terms))))
    scored = counted.filter(" or ".join(f"_f{i} > 0" for i in range(len(terms)))).crossJoin(F.broadcast(totals))  # totals: one row
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        n, f = F.col(f"_n{i}"), F.col(f"_f{i}")
        idf = F.ln((F.col("_n") - n + 0.5) / (n + 0.5))
        idf = F.when(idf <= 0, LEAST_IDF).otherwise(idf)
        part = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
        score = score + list(query).count(t) * part
    return scored.select(id_col, F.round(score, 9).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def similar_pairs(vectors: DataFrame, threshold: float, group: Column | None = None, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(a, b, similarity) with a < b at or over the threshold; with ``group``, inside a group only.

    Vectors of a group are dealt into chunks of ``CHUNK_ROWS`` and each pair of
    chunks is one unit of work, so a group of any size is spread over tasks and
    only pairs over the threshold leave them.  A vector without an id or group,
    or with a null, NaN or infinite component, has no pair; so have vectors of
    different lengths unless 0 reaches the threshold.
    """
    v = F.col(vector).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), (F.lit("") if group is None else group.cast("string")).alias("g"))
    rows = rows.filter("id is not null and v is not null and g is not null").filter(~bad).withColumn("d", F.size("v"))
    many = rows.groupBy("g", "d").agg(F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("n")).filter("n > 1")  # at most a row for each chunk
    rows = rows.join(F.broadcast(many), ["g", "d"], "left").withColumn("n", F.coalesce("n", F.lit(1)))
    own = F.pmod(F.xxhash64("id"), F.col("n")).cast("int")
    units = rows.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    units = units.select("g", "d", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "id", "v")

    def solve(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts).combine_chunks()
        d, i, j = (t[c][0].as_py() for c in ("d", "i", "j"))
        ids, m = t["id"].to_numpy(), t["v"].chunk(0).flatten().to_numpy().reshape(len(t), d)
        norm = np.zeros(len(t))
        for k in range(d):  # summed in the order of ``cosine``
            norm += m[:, k] * m[:, k]
        norm = np.sqrt(norm)
        unit = m / np.where(norm > 0, norm, 1)[:, None]
        cut = int((t["own"].to_numpy() == i).sum())
        left, right = np.arange(cut), np.arange(cut if i != j else 0, len(t))
        for s in range(0, len(left), SLICE):
            x, y = np.nonzero(unit[left[s : s + SLICE]] @ unit[right].T >= threshold - 1e-9)
            x, y = left[s : s + SLICE][x], right[y]
            keep = (ids[x] < ids[y]) if i == j else (ids[x] != ids[y])
            x, y = x[keep], y[keep]
            x, y = np.where(ids[x] < ids[y], x, y), np.where(ids[x] < ids[y], y, x)
            dot = np.zeros(len(x))
            for k in range(d):
                dot += m[x, k] * m[y, k]
            both = norm[x] * norm[y]
            cos = np.divide(dot, both, out=np.zeros(len(x)), where=both > 0)
            x, y, cos = (z[cos >= threshold] for z in (x, y, cos))
            yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(ids[y]), pa.array(cos)], names=["a", "b", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in by_unit(batches, 4):
            yield from solve(parts)

    dealt = units.repartition("g", "d", "i", "j").sortWithinPartitions("g", "d", "i", "j", "own", "id")
    return dealt.mapInArrow(run, "a long, b long, similarity double")


def by_unit(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.RecordBatch]]:
    """The batches of each unit of a sorted partition; the first ``keys`` columns name the unit."""
    now, held = None, []
    for batch in batches:
        key = list(zip(*(batch.column(k).to_pylist() for k in range(keys))))
        cut = [0, *(x for x in range(1, len(key)) if key[x] != key[x - 1]), len(key)]
        for s, e in zip(cut, cut[1:]):
            if e > s:
                if held and key[s] != now:
                    yield held
                    held = []
                now = key[s]
                held.append(batch.slice(s, e - s))
    if held:
        yield held


def leader_groups(spark: SparkSession, pairs: DataFrame, checkpoint) -> DataFrame:
    """(leader, member, similarity): greedy groups in id order, without a driver fold.

    A vertex leads if no earlier leader is its neighbour.  Each round decides
    all vertices whose earlier neighbours are decided: those without a leader
    among them lead, the others join their earliest leader.  ``checkpoint``
    materialises a DataFrame between rounds.
    """
    edges = checkpoint(pairs.select("a", "b", "similarity"))
    nodes = edges.select(F.col("a").alias("v")).union(edges.select("b")).distinct().withColumn("state", F.lit(0))
    nodes = checkpoint(nodes)  # 0 open, 1 leader, 2 member
    while True:
        early = edges.join(nodes.select(F.col("v").alias("a"), "state"), "a").groupBy(F.col("b").alias("v")).agg(F.max((F.col("state") == 1).cast("int")).alias("led"), F.max((F.col("state") == 0).cast("int")).alias("waits"))
        state = F.when(F.col("state") != 0, F.col("state")).when(F.col("led") == 1, 2).when(F.coalesce("waits", F.lit(0)) == 0, 1).otherwise(0)
        nodes = checkpoint(nodes.join(early, "v", "left").select("v", state.alias("state")))
        if nodes.filter("state = 0").isEmpty():
            break
    lead = nodes.filter("state = 1").select(F.col("v").alias("a"))
    member = nodes.filter("state = 2").select(F.col("v").alias("b"))
    own = edges.join(lead, "a").join(member, "b").groupBy("b").agg(F.min_by(F.struct("a", "similarity"), "a").alias("x"))
    return own.select(F.col("x.a").alias("leader"), F.col("b").alias("member"), F.col("x.similarity").alias("similarity"))


@dataclass(frozen=True)
class Clusters:
    """Centroids of an inverted file, and how many of them a search probes."""

    centres: np.ndarray
    probes: int


#: Rows that centroids are fitted on, and queries that the probes are set by.
FIT_ROWS, FIT_QUERIES = 8192, 128
MOST_CLUSTERS = 256


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null").filter(~bad)


def ivf_fit(vectors: DataFrame, k: int = 10, recall: float = 0.95, rounds: int = 12, id_col: str = "vec_id", vector: str = "embedding", most: int = MOST_CLUSTERS) -> Clusters:
    """Clusters fitted on at most ``FIT_ROWS`` rows, the first by a hash of their id.

    There are min(``most``, n / 10) of them, by Lloyd's rounds on unit vectors.  The
    probes are the fewest with which ``FIT_QUERIES`` of these rows find the given
    share of their k nearest rows.
    """
    rows = usable(vectors, id_col, vector)
    n = rows.count()
    share = min(1.0, 1.5 * FIT_ROWS / max(1, n))
    near = rows if share == 1.0 else rows.filter(F.xxhash64("id") < int((share - 0.5) * 2**64))
    sample = near.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).toArrow()  # FIT_ROWS vectors at most
    if not len(sample):
        return Clusters(np.zeros((1, 0)), 1)
    x = _unit(np.array(sample["v"].to_pylist()))
    centres = x[: min(most, max(1, n // 10), len(x))].copy()
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        moved = np.where(np.bincount(own, minlength=len(centres))[:, None] > 0, _unit(sums), centres)
        if np.abs(moved - centres).max() < 1e-6:
            break
        centres = moved
    own = (x @ centres.T).argmax(axis=1)
    q = x[:FIT_QUERIES]
    best = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, : k + 1]
    order = np.argsort(np.argsort(-(q @ centres.T), axis=1, kind="stable"), axis=1)
    place = np.sort(np.take_along_axis(order, own[best], axis=1).ravel())  # probes less one that each neighbour needs
    return Clusters(centres, int(place[min(len(place) - 1, int(np.ceil(recall * len(place))) - 1)]) + 1)


def place(rows: DataFrame, centres: np.ndarray, many: int) -> DataFrame:
    """(c, id, v): usable rows (id, v) in each of their ``many`` nearest clusters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.column(1).flatten().to_numpy().reshape(len(batch), -1)
            near = np.argsort(-(_unit(m) @ centres.T), axis=1, kind="stable")[:, :many]
            at = pa.array(np.repeat(np.arange(len(batch)), near.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), batch.column(0).take(at), batch.column(1).take(at)], names=["c", "id", "v"])

    return rows.mapInArrow(run, "c int, id long, v array<double>")


def ivf_search(vectors: DataFrame, clusters: Clusters, asked: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, id, similarity): the k nearest of all rows, in the probed clusters, for each row of ``asked``."""
    rows = place(usable(vectors, id_col, vector), clusters.centres, 1)
    return search_placed(rows, place(usable(asked, id_col, vector), clusters.centres, clusters.probes), k, id_col)


def search_placed(rows: DataFrame, asks: DataFrame, k: int, id_col: str = "vec_id") -> DataFrame:
    """(query_id, rank, id, similarity): each query's k nearest among the rows of its clusters (both c, id, v).

    Every row is in one cluster, every query in some of them; a large cluster is
    dealt into chunks of ``CHUNK_ROWS``, each of which meets the cluster's
    queries in one task.  A query does not find its own id.
    """
    sizes = rows.groupBy("c").agg(F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("n"))  # at most MOST_CLUSTERS rows
    rows = rows.join(F.broadcast(sizes), "c").select("c", F.pmod(F.xxhash64("id"), F.col("n")).cast("int").alias("u"), F.lit(1).alias("side"), "id", "v")
    asks = asks.join(F.broadcast(sizes), "c").select("c", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("u"), F.lit(0).alias("side"), "id", "v")

    def solve(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts).combine_chunks()
        cut = int((t["side"].to_numpy() == 0).sum())
        if not 0 < cut < len(t):
            return
        ids, m = t["id"].to_numpy(), _unit(t["v"].chunk(0).flatten().to_numpy().reshape(len(t), -1))
        for s in range(0, cut, SLICE):
            z = slice(s, min(cut, s + SLICE))
            cos = m[z] @ m[cut:].T
            cos[ids[z][:, None] == ids[None, cut:]] = -np.inf
            top = np.argpartition(-cos, min(k, cos.shape[1]) - 1, axis=1)[:, :k]
            value = np.take_along_axis(cos, top, axis=1)
            row, col = np.nonzero(value > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(ids[z][row]), pa.array(ids[cut:][top[row, col]]), pa.array(value[row, col])], names=["query_id", "id", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in by_unit(batches, 2):
            yield from solve(parts)

    dealt = rows.unionByName(asks).repartition("c", "u").sortWithinPartitions("c", "u", "side", "id")
    found = dealt.mapInArrow(run, "query_id long, id long, similarity double")
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "similarity")


def ranked(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows with their rank; only k rows meet in one task."""
    top = df.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
