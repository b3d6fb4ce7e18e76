"""Toxicity by weak supervision.

Voters are lexicon entries and word patterns: whole words and word beginnings
of 3 to 7 letters that turn up in toxic training documents far more often than
in others, mined by likelihood ratio, beside style patterns such as shouting.
A generative label model then estimates each voter's rates under either class
and the correlations left between voters once the class is known, discounts
correlated voters, and gives every training document a posterior label.  A
linear classifier on how often and how densely the voters fire is trained on
these posteriors and scores every whole text.

The fit uses a bounded, documented sample of labelled rows (labelled.SAMPLE_ROWS)
outside the held-out fold and at most ``MAX_VOTERS`` voters; the broadcast model
is therefore of bounded size.  Scoring is one pass without a shuffle.

Edge cases: null and empty texts fire no voter and get the classifier's base
score; without labels, or with labels of one class alone, every score is that
class's share (0 without any).  Null ids are scored and never held out; other
columns, repeated rows and an empty table need no care.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import SAMPLE_ROWS, held_out, training_sample
from .textkernel import PUNCTUATION, Chunk, chunks, mix

MAX_VOTERS = 400
#: A mined voter's least likelihood ratio (natural logarithm).
LEAST_RATIO = 8.0
PREFIXES = (3, 4, 5, 6, 7)
#: How far a label in the sample speaks for itself, as log odds.
LABEL_ODDS = 4.0
STYLE = 2


def lexicon_hashes(chunk: Chunk) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(documents, hashes) of every word, then of its beginnings by length."""
    yield chunk.word_doc, mix(chunk.word_hash())
    char = np.append(np.flatnonzero((chunk.data & 0xC0) != 0x80), len(chunk.data))
    first = np.searchsorted(char, chunk.start)
    for size in PREFIXES:
        end = char[np.minimum(first + size, len(char) - 1)]
        long = end <= chunk.end
        yield chunk.word_doc[long], chunk.hash_spans(chunk.start[long], end[long])


def style_votes(chunk: Chunk) -> np.ndarray:
    """Style patterns of each document: shouting, and runs of exclamations."""
    upper = chunk.per_doc((chunk.data >= 65) & (chunk.data <= 90))
    bang = chunk.data == 33
    runs = chunk.per_doc(np.concatenate([[False], bang[1:] & bang[:-1]])[: len(bang)])
    size = np.maximum(np.diff(chunk.offsets), 1)
    return np.stack([upper > 0.5 * size, runs > 0.02 * size], axis=1).astype(np.float32)


def mine(sample: DataFrame, n_toxic: int, n_clean: int) -> np.ndarray:
    """Hashes of the words and beginnings that tell the classes apart best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False) == 1
            for a, _, chunk in chunks(batch.column(0), lower=True, breaks=PUNCTUATION):
                found = list(lexicon_hashes(chunk))
                doc, h = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
                _, once = np.unique(mix(h ^ mix(doc.astype(np.uint64) + np.uint64(1))), return_index=True)
                value, back = np.unique(h[once], return_inverse=True)
                both = np.bincount(back, minlength=len(value))
                bad = np.bincount(back, weights=toxic[doc[once] + a], minlength=len(value)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(bad), pa.array(both - bad)], names=["h", "bad", "good"])

    found = sample.mapInArrow(run, "h long, bad long, good long").groupBy("h").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    p1, p0 = (F.col("bad") + 0.5) / (n_toxic + 1.0), (F.col("good") + 0.5) / (n_clean + 1.0)
    ratio = F.col("bad") * F.log(p1 / p0) + (n_toxic - F.col("bad")) * F.log((1 - p1) / (1 - p0))
    best = found.filter("bad >= 2").filter(p1 > p0).withColumn("ratio", ratio).filter(F.col("ratio") > LEAST_RATIO)
    rows = best.orderBy(F.desc("ratio"), "h").limit(MAX_VOTERS).select("h").collect()
    return np.sort(np.array([r["h"] for r in rows], np.int64).view(np.uint64))


def fire(chunk: Chunk, voters: np.ndarray) -> np.ndarray:
    """How often each voter fires in each document, style patterns last."""
    out = np.zeros((chunk.n, len(voters) + STYLE), np.float32)
    if len(voters):
        for doc, h in lexicon_hashes(chunk):
            at = np.minimum(np.searchsorted(voters, h), len(voters) - 1)
            hit = np.flatnonzero(voters[at] == h)
            np.add.at(out, (doc[hit], at[hit]), 1)
    out[:, len(voters) :] = style_votes(chunk)
    return out


def signals(counts: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """What the classifier sees: how often, and how densely, voters fire."""
    return np.concatenate([np.log1p(counts), 3 * counts / np.sqrt(np.maximum(n_words, 1))[:, None]], axis=1)


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 10) -> np.ndarray:
    """Posterior labels from votes, by expectation maximisation.

    Voters abstain or vote; their rates under either class are the accuracies.
    What two voters share beyond the class is their correlation, and a voter's
    evidence is divided by the correlated evidence that it belongs to.
    """
    v = votes.astype(np.float64)
    q = np.where(labels > 0, 0.95, 0.05)
    for _ in range(rounds):
        share = np.clip(q.mean(), 0.01, 0.99)
        t1, t0 = (q @ v + 0.5) / (q.sum() + 1), ((1 - q) @ v + 0.5) / ((1 - q).sum() + 1)
        rest = v - (q[:, None] * t1 + (1 - q)[:, None] * t0)
        norm = np.sqrt((rest * rest).sum(axis=0)) + 1e-9
        shared = np.abs(rest.T @ rest) / norm[:, None] / norm[None, :]
        weight = 1 / np.maximum(1, np.where(shared > 0.2, shared, 0).sum(axis=0))
        odds = np.log(share / (1 - share)) + v @ (weight * np.log(t1 / t0)) + (1 - v) @ (weight * np.log((1 - t1) / (1 - t0)))
        q = 1 / (1 + np.exp(-np.clip(odds + LABEL_ODDS * (2 * labels - 1), -30, 30)))
    return q


def linear_fit(x: np.ndarray, q: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression on soft labels, by Newton steps; the last weight is the constant."""
    a = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(a.shape[1])
    penalty = np.append(np.full(x.shape[1], ridge), 1e-3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hessian = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(hessian, a.T @ (p - q) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


@dataclass(frozen=True)
class Model:
    voters: np.ndarray
    weights: np.ndarray
    constant: float

    def scores(self, chunk: Chunk) -> np.ndarray:
        if not len(self.weights):
            return np.full(chunk.n, self.constant)
        z = signals(fire(chunk, self.voters), chunk.n_words) @ self.weights + self.constant
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = SAMPLE_ROWS) -> Model:
    sample = training_sample(spark, docs, labels, label, max_rows=max_rows)
    n = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}  # one row for each class
    bad, good = n.get(1, 0), sum(n.values()) - n.get(1, 0)
    if not bad or not good:
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(bad > 0))
    voters = mine(sample, bad, good)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, chunk in chunks(batch.column(0), lower=True, breaks=PUNCTUATION):
                counts = np.minimum(fire(chunk, voters), 60_000).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in counts], pa.binary()), pa.array(chunk.n_words.astype(np.int64)), batch.column(1).slice(a, b - a)], names=["counts", "n_words", "y"])

    rows = sample.mapInArrow(run, "counts binary, n_words long, y int").toArrow()  # max_rows rows of 2 * MAX_VOTERS bytes
    counts = np.frombuffer(b"".join(rows["counts"].to_pylist()), np.uint16).reshape(len(rows), -1).astype(np.float32)
    y = (rows["y"].to_numpy() == 1).astype(np.float64)
    order = np.lexsort([*counts.T[:8], rows["n_words"].to_numpy(), y])  # the same sums whatever order the rows came in
    counts, y, n_words = counts[order], y[order], rows["n_words"].to_numpy()[order]
    w = linear_fit(signals(counts, n_words), label_model(counts > 0, y))
    return Model(voters, w[:-1], float(w[-1]))


def score(docs: DataFrame, model: Model, threshold: float, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row, from its whole text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, chunk in chunks(batch.column(2), lower=True, breaks=PUNCTUATION):
                s = model.scores(chunk)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    source = docs.select(F.col(id_col).cast("long").alias(id_col), held_out(id_col).alias("held_out"), F.col(text).alias("text"))
    return source.mapInArrow(run, f"`{id_col}` long, held_out boolean, score double, predicted int")
