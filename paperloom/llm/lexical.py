"""Ranked lexical search with block-max pruning over a kept forward index.

``build`` tokenises documents once.  A block is a range of documents as they lie
in the table, about ``BLOCK_BYTES`` of text.  Its head lists its terms with, for
each, the number of documents that hold it, its largest frequency and the least
ratio of a document's length to its frequency; its body is the forward index:
documents, their lengths, and their terms with frequencies.  Nothing in a block
depends on the corpus, so blocks can be added without touching the others.

``search`` takes queries in groups of bounded number and size, which travel to all blocks:

1. Heads give the document frequencies of the group's terms, and so the weights.
2. Heads give an upper bound of each query's score in each block, from the
   per-term maxima.  Each query's ``FIRST`` blocks of the highest bound are scored from
   their bodies; the k-th best score is its threshold.
3. Each task takes its blocks by falling bound.  A query whose bound in a block
   is under its threshold skips it; a body none of whose queries is left is not
   unpacked.  What is scored raises the task's threshold further.

A document outside the result scores under the threshold, or equals it with a
larger id: a block is skipped only if its bound is lower than the threshold, so
ranks are exact.  Scores are whole numbers; products are taken in float64 while
every sum is exact there, else in 64-bit integers.

Edge cases: null and empty texts have no terms and are neither counted nor
found; so have items, which then find nothing.  Rows without an id take no part.
Rows that share an id are documents, or items, of their own.  Other columns do
not matter, whatever their names; empty tables give an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import materialize
from .textkernel import PUNCTUATION, chunks

#: Terms are the maximal matches, A-Z lower-cased.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Text of a block: its bounds are the looser, the more documents share its maxima.
BLOCK_BYTES = 1 << 15
#: Items, and bytes of their texts, that travel to all blocks at once.
QUERIES = 1024
QUERY_BYTES = 8 << 20
#: Blocks of each query that are scored for its threshold.
FIRST = 4
#: Entries of one matrix of documents and terms, or of queries and terms.
CELLS = 1 << 21

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLOCK = "docs long, words long, head binary, body binary"


def _packed(**columns) -> pa.Buffer:
    batch = pa.RecordBatch.from_pydict(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue()


def _unpacked(cell: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(cell.as_buffer()).read_next_batch()


def _block(ids: np.ndarray, chunk) -> tuple[int, int, bytes, bytes] | None:
    """A block's numbers, head and body; none if it has no terms."""
    if not len(chunk.start):
        return None
    at = np.concatenate([[0], np.cumsum(chunk.end - chunk.start)]).astype(np.int32)
    flat = _LOWER[chunk.data[chunk.is_word]]
    words = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(flat)]).dictionary_encode()
    many = len(words.dictionary)
    entry, tf = np.unique(chunk.word_doc * np.int64(many) + words.indices.to_numpy(), return_counts=True)
    doc, term = entry // many, entry % many
    order = np.argsort(term, kind="stable")
    start = np.searchsorted(term[order], np.arange(many))
    df = np.diff(np.append(start, len(term)))
    # rounded down, so the impact that follows from it is rounded up
    least = np.nextafter((chunk.n_words[doc] / tf)[order].astype(np.float32), np.float32(0))
    head = _packed(term=words.dictionary, df=pa.array(df.astype(np.uint32)), top=pa.array(np.maximum.reduceat(tf[order], start).astype(np.uint32)), least=pa.array(np.minimum.reduceat(least, start)))
    full = np.flatnonzero(chunk.n_words)
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.append(full, chunk.n)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(term.astype(np.uint32)), pa.array(tf.astype(np.uint32))], ["term", "tf"]))
    body = _packed(id=pa.array(ids[full]), n=pa.array(chunk.n_words[full].astype(np.int64)), terms=lists)
    return len(full), len(chunk.start), head.to_pybytes(), body.to_pybytes()


def build(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The written index: (block, docs, words, head, body), a row for each block."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).filter("id is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, b, chunk in chunks(batch.column(1), limit=BLOCK_BYTES, breaks=PUNCTUATION):
                if found := _block(ids[a:b], chunk):
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in found], names=["docs", "words", "head", "body"])

    return materialize(spark, docs.mapInArrow(run, _BLOCK).withColumn("block", F.monotonically_increasing_id()), "lexical-index")


@dataclass(frozen=True)
class Group:
    """Some queries: ``weight`` of term ``vid`` in query ``q``, and what is known of the corpus."""

    items: np.ndarray
    terms: pa.Array
    q: np.ndarray
    vid: np.ndarray
    times: np.ndarray
    docs: int = 0
    words: int = 0
    weight: np.ndarray | None = None
    threshold: np.ndarray | None = None

    def impact(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 75 + (25 * n * self.docs) // self.words
        return (1_000_000_000 * tf) // (1000 * tf + 12 * m)

    def most(self, top: np.ndarray, least: np.ndarray) -> np.ndarray:
        """An upper bound of the impact of any document of a block, by term."""
        m_by_tf = 74 / top + 25 * self.docs / self.words * least.astype(np.float64)  # m is rounded down by less than one
        return np.floor(1e9 / (1000 + 12 * m_by_tf)) + 2

    def bounds(self, head: pa.RecordBatch) -> np.ndarray:
        """By query, the most that a document of the block may score."""
        local = pc.index_in(self.terms, value_set=head["term"]).fill_null(-1).to_numpy()
        most = np.zeros(len(self.terms))
        here = local >= 0
        most[here] = self.most(head["top"].to_numpy()[local[here]].astype(np.float64), head["least"].to_numpy()[local[here]])
        return np.ceil(np.bincount(self.q, self.weight * most[self.vid], len(self.items)) * (1 + 1e-12))

    def scores(self, head: pa.RecordBatch, body: pa.RecordBatch, asked: np.ndarray, threshold: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of each asked query's k best documents of the block, at or over its threshold."""
        chosen = np.isin(self.q, asked)
        vids = np.unique(self.vid[chosen])
        local = pc.index_in(self.terms.take(pa.array(vids)), value_set=head["term"]).fill_null(-1).to_numpy()
        vids, local = vids[local >= 0], local[local >= 0]
        column = np.full(len(head), -1)
        column[local] = np.arange(len(local))
        slot = np.full(len(self.terms), -1)
        slot[vids] = np.arange(len(vids))
        place = np.full(len(self.items), -1)
        place[asked] = np.arange(len(asked))
        ids, n, lists = body["id"].to_numpy(), body["n"].to_numpy(), body["terms"]
        doc = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy())
        entries = lists.flatten()
        at, tf = column[entries.field("term").to_numpy()], entries.field("tf").to_numpy().astype(np.int64)
        doc, at, tf = doc[at >= 0], at[at >= 0], tf[at >= 0]
        impact = self.impact(tf, n[doc])
        own = np.flatnonzero(chosen & (slot[self.vid] >= 0))
        row, col, weight = place[self.q[own]], slot[self.vid[own]], self.weight[own]
        kind = np.float64 if float(np.bincount(row, weight, 1).max(initial=0)) * 1e6 < 2**53 else np.int64
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step = max(1, CELLS // max(1, len(vids)))
        for a in range(0, len(asked), step):
            part = (row >= a) & (row < a + step)
            by_query = np.zeros((min(step, len(asked) - a), len(vids)), kind)
            by_query[row[part] - a, col[part]] = weight[part]
            least = np.maximum(1, threshold[asked[a : a + step]])
            for d in range(0, len(ids), step):
                s, e = np.searchsorted(doc, [d, d + step])
                by_doc = np.zeros((min(step, len(ids) - d), len(vids)), kind)
                by_doc[doc[s:e] - d, at[s:e]] = impact[s:e]
                total = by_doc @ by_query.T
                x, y = np.nonzero(total >= least)
                out.append((asked[a + y], ids[d + x], total[x, y].astype(np.int64)))
        query, found, score = (np.concatenate([x[i] for x in out]) for i in range(3))
        order = np.lexsort((found, -score, query))
        query, found, score = query[order], found[order], score[order]
        first = np.searchsorted(query, query)
        keep = np.arange(len(query)) - first < k
        return query[keep], found[keep], score[keep]


def _group(rows: list) -> Group:
    counts = [Counter(m.lower() for m in TERM.findall((r["text"] or "").encode())) for r in rows]
    terms = sorted(set().union(*counts)) if counts else []
    vid = {t: i for i, t in enumerate(terms)}
    entries = [(q, vid[t], n) for q, c in enumerate(counts) for t, n in sorted(c.items())]
    q, v, n = (np.array(x, np.int64) for x in zip(*entries)) if entries else (np.zeros(0, np.int64),) * 3
    return Group(np.array([r["id"] for r in rows], np.int64), pa.array(terms, pa.binary()), q, v, n)


def _weighed(index: DataFrame, group: Group) -> Group:
    """The group with its terms' weights."""
    terms = group.terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for cell in batch.column(0):
                head = _unpacked(cell)
                local = pc.index_in(terms, value_set=head["term"]).fill_null(-1).to_numpy()
                total[local >= 0] += head["df"].to_numpy()[local[local >= 0]]
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], names=["vid", "df"])

    docs, words = index.agg(F.sum("docs"), F.sum("words")).first()
    df = np.zeros(len(terms), np.int64)
    for r in index.select("head").mapInArrow(run, "vid long, df long").groupBy("vid").agg(F.sum("df").alias("df")).collect():  # the group's terms at most
        df[r["vid"]] = r["df"]
    weight = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    return replace(group, docs=docs, words=words, weight=group.times * weight[group.vid])


def _first_blocks(index: DataFrame, group: Group) -> dict[int, list[int]]:
    """Block to queries: each query's ``FIRST`` blocks of the highest bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, blocks = np.zeros((len(group.items), 0)), np.zeros((len(group.items), 0), np.int64)
        for batch in batches:
            bound = np.stack([group.bounds(_unpacked(cell)) for cell in batch.column(1)], axis=1) if len(batch) else best[:, :0]
            best, blocks = np.concatenate([best, bound], axis=1), np.concatenate([blocks, np.broadcast_to(batch.column(0).to_numpy(), bound.shape)], axis=1)
            order = np.argsort(-best, axis=1, kind="stable")[:, :FIRST]
            best, blocks = np.take_along_axis(best, order, axis=1), np.take_along_axis(blocks, order, axis=1)
        q, at = np.nonzero(best > 0)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(blocks[q, at]), pa.array(best[q, at])], names=["q", "block", "bound"])

    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "block"))
    rows = index.select("block", "head").mapInArrow(run, "q long, block long, bound double").withColumn("rank", rank).filter(F.col("rank") <= FIRST)
    out: dict[int, list[int]] = {}
    for r in rows.select("q", "block").collect():  # QUERIES * FIRST rows at most
        out.setdefault(r["block"], []).append(r["q"])
    return out


_FOUND = "q long, item_id long, doc_id long, score long"


def _found(group: Group, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query), pa.array(group.items[query]), pa.array(ids), pa.array(score)], names=["q", "item_id", "doc_id", "score"])


def _thresholds(spark: SparkSession, index: DataFrame, group: Group, k: int) -> Group:
    """The group with each query's k-th best score in its first blocks."""
    first = _first_blocks(index, group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, head, body in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                asked = np.array(sorted(first[block]))
                yield _found(group, *group.scores(_unpacked(head), _unpacked(body), asked, np.zeros(len(group.items)), k))

    threshold = np.ones(len(group.items), np.int64)
    if first:
        rows = index.filter(F.col("block").isin(list(first))).select("block", "head", "body").mapInArrow(run, _FOUND)
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc_id"))
        for r in rows.withColumn("rank", rank).filter(F.col("rank") <= k).filter(F.col("rank") == k).select("q", "score").collect():  # a row for each query
            threshold[r["q"]] = r["score"]
    return replace(group, threshold=threshold)


def _score(index: DataFrame, group: Group, k: int) -> DataFrame:
    """All documents that may be among a query's k best, each block's k best at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((len(group.items), k), np.int64)
        least = group.threshold.copy()
        for batch in batches:
            heads = [_unpacked(cell) for cell in batch.column(0)]
            bounds = [group.bounds(head) for head in heads]
            for i in sorted(range(len(heads)), key=lambda i: -bounds[i].max(initial=0)):
                asked = np.flatnonzero(bounds[i] >= least)
                if not len(asked):
                    continue
                query, ids, score = group.scores(heads[i], _unpacked(batch.column(1)[i]), asked, least, k)
                yield _found(group, query, ids, score)
                for q in np.unique(query):
                    best[q] = np.sort(np.concatenate([best[q], score[query == q]]))[-k:]
                    least[q] = max(least[q], best[q, 0])

    return index.select("head", "body").mapInArrow(run, _FOUND)


def search(spark: SparkSession, index: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0.

    Items are taken in groups of ``QUERIES`` rows and ``QUERY_BYTES`` of text on average.
    """
    asked = materialize(spark, queries.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).filter("id is not null"), "queries")
    rows, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    groups = max(1, -(-rows // QUERIES), -(-size // QUERY_BYTES))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc_id"))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    empty = index.isEmpty()
    for g in range(groups):
        some = asked.filter(F.pmod(F.xxhash64("id", "text"), F.lit(groups)) == g).orderBy("id", "text")
        group = _group(some.collect())  # a bounded share of the queries
        if len(group.q) and not empty:
            group = _thresholds(spark, index, _weighed(index, group), k)
            best = _score(index, group, k).withColumn("rank", rank).filter(F.col("rank") <= k)
            out = out.union(best.select("item_id", F.col("rank").cast("int"), "doc_id", "score"))
    return out
