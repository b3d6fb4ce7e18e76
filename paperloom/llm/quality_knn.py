"""Quality by nearest-neighbour voting in a latent-semantic space.

A document's terms are its words and their beginnings, the shapes of its words
(runs of capitals, letters, digits and each punctuation mark), word lengths, and
marks of repetition: words that repeat one of the two before them, words in
repeated three-word windows, and repeated lines.  Log term shares, weighted by
rarity, are projected on the leading singular vectors of a bounded sample of
labelled documents.  A chunk's terms are held as sparse triples, so short texts
cost no more than long ones.  The
sample's vectors are broadcast (at most ``SAMPLE_ROWS`` times ``RANK`` floats);
every document's cosine with all of them is computed exactly in blocks, and its
nearest neighbours vote with their label, weighted by similarity.

Edge cases: a text without words has no direction and gets the sample's share
of good labels, as every text does when no labelled row exists (then 0).  Null
ids are scored and never held out; ties between neighbours go to the earlier
sample row, which has a fixed order; other columns, repeated rows and an empty
table need no care.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import held_out, training_sample
from .quality_rules import View
from .textkernel import Chunk, chunks, mix

SAMPLE_ROWS = 4_000
#: Buckets of word shapes, and of words and their beginnings.
SHAPES, LEXICAL = 992, 3072
#: Bytes of a word's beginning.
BEGINNING = 4
LEXICAL_WEIGHT = 0.25
RANK = 48
NEIGHBOURS = 15
#: Similarities count to this power.
SHARPNESS = 8
BLOCK = 512
#: Texts that are projected at a time.
ROWS = 64

# classes of bytes: every ASCII mark is its own, letters and digits are three
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91] = ord("A")
_CLASS[97:123] = ord("a")
_CLASS[128:] = ord("a")
_CLASS[48:58] = ord("0")
_LENGTHS, _MARKS = 24, 8
SURFACE = SHAPES + _LENGTHS + _MARKS
TERMS = SURFACE + LEXICAL


def terms(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count) of all terms, by document; one entry for each pair."""
    kind = _CLASS[chunk.data]
    fresh = np.ones(len(kind), bool)
    fresh[1:] = kind[1:] != kind[:-1]
    fresh[chunk.start] = True
    at = np.concatenate([[0], np.cumsum(fresh)])
    shapes = Chunk(kind[fresh], np.array([0, int(at[-1])]))
    shape = shapes.hash_spans(at[chunk.start], at[chunk.end]) % np.uint64(SHAPES)
    size = np.minimum(chunk.end - chunk.start, _LENGTHS) - 1
    doc, h = chunk.word_doc, chunk.word_hash()
    begin = chunk.hash_spans(chunk.start, np.minimum(chunk.start + BEGINNING, chunk.end))
    again = np.zeros(len(h), bool)
    for back in (1, 2):
        again[back:] |= (h[back:] == h[:-back]) & (doc[back:] == doc[:-back])
    view = View(chunk)
    marks = [np.bincount(doc[again], minlength=chunk.n), view["n_repeat_words"], view["n_dup_lines"] * 8, view["n_lines"]]
    words = [shape, SHAPES + size, SURFACE + h % np.uint64(LEXICAL), SURFACE + mix(begin) % np.uint64(LEXICAL)]
    key = np.concatenate([doc * TERMS + w.astype(np.int64) for w in words])
    key, many = np.unique(key, return_counts=True)
    every = np.arange(chunk.n)
    key = np.concatenate([key, *(every * TERMS + SHAPES + _LENGTHS + k for k in range(len(marks)))])
    many = np.concatenate([many, *marks])
    key, many = key[many > 0], many[many > 0]
    order = np.argsort(key, kind="stable")
    return key[order] // TERMS, key[order] % TERMS, many[order]


def weighted(term: np.ndarray, many: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Log of a term's count in a hundred words; what the words say counts less than how they look."""
    return np.log1p(100.0 * many / np.maximum(n_words, 1)) * np.where(term < SURFACE, 1.0, LEXICAL_WEIGHT)


def leading_axes(x: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors of ``x``, by subspace iteration."""
    rng = np.random.Generator(np.random.PCG64(7))
    base = np.linalg.qr(rng.standard_normal((x.shape[1], min(rank + 16, *x.shape))))[0].astype(x.dtype)
    for _ in range(8):
        base = np.linalg.qr(x.T @ (x @ base))[0]
    _, _, turn = np.linalg.svd(x @ base, full_matrices=False)
    return np.ascontiguousarray((base @ turn.T)[:, :rank])


@dataclass(frozen=True)
class Model:
    base: np.ndarray  # what a text of mean weights projects to
    rare: np.ndarray  # weight of each term
    axes: np.ndarray  # TERMS x RANK
    vectors: np.ndarray  # labelled rows, unit length
    labels: np.ndarray
    share: float

    def project(self, doc: np.ndarray, term: np.ndarray, many: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        x = np.zeros((len(n_words), self.axes.shape[1]))
        if len(doc):
            at = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            weight = weighted(term, many, n_words[doc]) * self.rare[term]
            for a in range(0, len(at), ROWS):  # a bounded number of texts at a time
                own = at[a : a + ROWS]
                z = slice(own[0], at[a + ROWS] if a + ROWS < len(at) else len(doc))
                x[doc[own]] = np.add.reduceat(weight[z, None] * self.axes[term[z]], own - own[0], axis=0)
        x -= self.base
        x[n_words == 0] = 0
        return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def scores(self, chunk: Chunk) -> np.ndarray:
        out = np.full(chunk.n, self.share)
        if not len(self.labels):
            return out
        unit = self.project(*terms(chunk), chunk.n_words)
        k = min(NEIGHBOURS, len(self.labels))
        for a in range(0, chunk.n, BLOCK):
            cosine = unit[a : a + BLOCK] @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            w = np.clip(np.take_along_axis(cosine, near, axis=1), 0, 1).astype(np.float64) ** SHARPNESS
            total = w.sum(axis=1)
            vote = (w * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-300)
            out[a : a + BLOCK] = np.where(total > 1e-12, np.clip(vote, 0, 1), self.share)
        return out


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = SAMPLE_ROWS) -> Model:
    sample = training_sample(spark, docs, labels, label, max_rows=max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, chunk in chunks(batch.column(0)):
                doc, term, many = terms(chunk)
                lists = lambda x: pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(chunk.n + 1)).astype(np.int32)), pa.array(x.astype(np.int32)))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([lists(term), lists(many), pa.array(chunk.n_words.astype(np.int64)), batch.column(1).slice(a, b - a)], names=["term", "many", "n_words", "y"])

    rows = sample.mapInArrow(run, "term array<int>, many array<int>, n_words long, y int").toArrow().combine_chunks()  # max_rows sparse rows
    n = len(rows)
    if not n:
        return Model(*(np.zeros(0),) * 5, 0.0)
    size = pc.list_value_length(rows["term"]).to_numpy()
    start = np.cumsum(size) - size
    term, many = (pc.list_flatten(rows[c]).to_numpy() for c in ("term", "many"))
    n_words, y = rows["n_words"].to_numpy(), (rows["y"].to_numpy() == 1).astype(np.float64)
    row = lambda i: (y[i], term[start[i] : start[i] + size[i]].tobytes(), many[start[i] : start[i] + size[i]].tobytes())
    order = np.array(sorted(range(n), key=row))  # the same rows whatever order they came in
    place = np.argsort(order)
    doc = np.repeat(place, size)
    by = np.argsort(doc, kind="stable")
    doc, term, many, n_words, y = doc[by], term[by], many[by], n_words[order], y[order]
    x = np.zeros((n, TERMS), np.float32)
    x[doc, term] = weighted(term, many, n_words[doc])
    rare = np.log((1 + n) / (1 + np.bincount(term, minlength=TERMS))) + 1
    mean = x.mean(axis=0)
    x -= mean
    x *= rare.astype(np.float32)
    axes = leading_axes(x, RANK)
    model = Model((mean * rare) @ axes, rare, axes, np.zeros(0), y, float(y.mean()))
    return Model(model.base, rare, axes, model.project(doc, term, many, n_words), y, model.share)


def score(docs: DataFrame, model: Model, threshold: float, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row, from its whole text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, chunk in chunks(batch.column(2)):
                s = model.scores(chunk)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    source = docs.select(F.col(id_col).cast("long").alias(id_col), held_out(id_col).alias("held_out"), F.col(text).alias("text"))
    return source.mapInArrow(run, f"`{id_col}` long, held_out boolean, score double, predicted int")
