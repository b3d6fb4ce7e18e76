"""Quality rules as a short-circuit cascade ordered by rejection per cost.

Each rule looks at a few document features and rejects.  On a bounded sample
every rule is run over every sampled document, which gives its selectivity and
its cost; the cascade then runs the rules by falling rejections per nanosecond,
and each rule only ever sees the documents that no earlier rule rejected.  The
verdict does not depend on the order, so reruns agree though timings differ.

Edge cases, all covered by tests: a null or empty text has no words and fails
the base; other null columns, repeated rows, ties and extra columns (also ones
named like an output) pass through untouched; an empty table gives an empty
result of the same schema.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import map_rows, quoted
from .textkernel import SYMBOLS, Chunk, chunks, mix

#: The bounded sample on which costs and selectivities are estimated.
SAMPLE_ROWS = 500
SAMPLE_BYTES = 1 << 16

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True


class View:
    """Some documents of a chunk; features are computed when first asked for."""

    def __init__(self, source: Chunk):
        self.source, self.rows, self.known = source, None, {}

    @property
    def n(self) -> int:
        return self.source.n if self.rows is None else len(self.rows)

    def take(self, keep: np.ndarray) -> View:
        """The chosen documents, with what is already known about them."""
        out = View(self.source)
        out.rows = np.flatnonzero(keep) if self.rows is None else self.rows[keep]
        out.known = {k: v[keep] for k, v in self.known.items()}
        return out

    @property
    def chunk(self) -> Chunk:
        """Holds these documents alone, so later features cost only them."""
        if self.rows is not None:
            c, rows = self.source, self.rows
            parts = [c.data[c.offsets[r] : c.offsets[r + 1]] for r in rows]
            sizes = np.array([len(p) for p in parts], np.int64)
            data = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
            self.source, self.rows = Chunk(data, np.concatenate([[0], np.cumsum(sizes)]), c.lower), None
        return self.source

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self.known:
            self.known[name] = FEATURES[name](self)
        return self.known[name]


def _word_chars(v: View) -> np.ndarray:
    c = v.chunk
    return c.per_doc(c.is_word & ((c.data & 0xC0) != 0x80))


def _lines(v: View) -> np.ndarray:
    c = v.chunk
    return np.bincount(c.lines()[2], minlength=c.n)


def _dup_lines(v: View) -> np.ndarray:
    c = v.chunk
    start, end, doc = c.lines()
    key = mix(c.hash_spans(start, end) ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(key, return_index=True)
    return np.bincount(doc, minlength=c.n) - np.bincount(doc[first], minlength=c.n)


def _repeat_words(v: View) -> np.ndarray:
    c = v.chunk
    at, gram = c.grams(3)
    key = mix(gram ^ mix(c.word_doc[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    ranked = key[order]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    twice = at[order[same[:-1] | same[1:]]]
    covered = np.zeros(len(c.start) + 3, bool)
    for j in range(3):
        covered[twice + j] = True
    return np.bincount(c.word_doc[covered[: len(c.start)]], minlength=c.n)


FEATURES = {
    "n_words": lambda v: v.chunk.n_words.astype(np.int64),
    "word_chars": _word_chars,
    "n_symbols": lambda v: v.chunk.per_doc(SYMBOLS[v.chunk.data]),
    "n_upper": lambda v: v.chunk.per_doc(_UPPER[v.chunk.data]),
    "n_letters": lambda v: v.chunk.per_doc(_LETTER[v.chunk.data]),
    "n_exclaim": lambda v: v.chunk.per_doc(v.chunk.data == 33),
    "n_lines": _lines,
    "n_dup_lines": _dup_lines,
    "n_repeat_words": _repeat_words,
}
#: The four counts that every result row carries.
BASE_FEATURES = ["word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Limits:
    """Thresholds of all rules; the first two are the base rules'."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbols_per_word: float = 0.25
    max_upper_share: float = 0.6
    max_exclaim_per_word: float = 0.3
    max_dup_line_share: float = 0.5
    min_word_chars: float = 1.5
    max_word_chars: float = 25.0


BASE_RULES = {
    "too_few_words": lambda v, p: v["n_words"] < p.min_words,
    "repeated_words": lambda v, p: 100 * v["n_repeat_words"] > p.max_repeat_percent * v["n_words"],
}
RULES = {
    "symbols": lambda v, p: v["n_symbols"] > p.max_symbols_per_word * v["n_words"],
    "shouting": lambda v, p: v["n_upper"] > p.max_upper_share * np.maximum(v["n_letters"], 1),
    "exclamations": lambda v, p: v["n_exclaim"] > p.max_exclaim_per_word * v["n_words"],
    "repeated_lines": lambda v, p: v["n_dup_lines"] > p.max_dup_line_share * v["n_lines"],
    "short_words": lambda v, p: v["word_chars"] < p.min_word_chars * v["n_words"],
    "long_words": lambda v, p: v["word_chars"] > p.max_word_chars * v["n_words"],
}


@dataclass(frozen=True)
class Cascade:
    """Rules in the order they run, and the limits they use."""

    order: tuple[str, ...]
    limits: Limits = field(default_factory=Limits)

    def passes(self, view: View) -> np.ndarray:
        """Positions of the documents that no rule rejects.

        A rule sees only the documents that every rule before it let pass.
        """
        rules = BASE_RULES | RULES
        alive = np.arange(view.n)
        for name in self.order:
            if not len(alive):
                break
            good = ~rules[name](view, self.limits)
            if not good.all():
                alive, view = alive[good], view.take(good)
        return alive


def plan_cascade(docs: DataFrame, text: str = "text", rules: tuple[str, ...] | None = None, limits: Limits = Limits(), sample_rows: int = SAMPLE_ROWS) -> Cascade:
    """Order rules by rejections per nanosecond, measured on a bounded sample.

    The sample is the first ``sample_rows`` texts of at most ``SAMPLE_BYTES``
    bytes that the scan gives, so it reads a few files' beginnings and takes a
    bounded part of the driver.  It steers speed alone, never a verdict.
    """
    every = BASE_RULES | RULES
    names = tuple(rules if rules is not None else every)
    rejected, spent = dict.fromkeys(names, 0), dict.fromkeys(names, 1)
    sample = docs.select(text).filter(F.octet_length(text) <= SAMPLE_BYTES).limit(sample_rows).toArrow()
    for part in sample.column(0).chunks:
        for _, _, chunk in chunks(part):
            for name in names:
                view = View(Chunk(chunk.data, chunk.offsets))  # nothing known: a rule pays for its own features
                began = time.perf_counter_ns()
                rejected[name] += int(every[name](view, limits).sum())
                spent[name] += time.perf_counter_ns() - began
    return Cascade(tuple(sorted(names, key=lambda x: (-(rejected[x] + 0.5) / spent[x], x))), limits)


def assess(docs: DataFrame, cascade: Cascade, text: str = "text") -> DataFrame:
    """Every input column, then n_words, the four counts, base_failed and kept.

    Input columns named like an output are replaced by it.
    """
    added = ["n_words", *BASE_FEATURES, "base_failed", "kept"]
    source = docs.select(*[quoted(c) for c in docs.columns if c not in added or c == text])
    others = tuple(x for x in cascade.order if x not in BASE_RULES)
    rest = Cascade(others, cascade.limits)
    kinds = [T.StructField(n, T.LongType()) for n in added[:5]] + [T.StructField(n, T.BooleanType()) for n in added[5:]]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = {n: np.zeros(batch.num_rows, np.int64) for n in added[:5]}
            failed, kept = np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows, bool)
            for a, b, chunk in chunks(batch.column(batch.schema.get_field_index(text))):
                view = View(chunk)
                for n in added[:5]:
                    got[n][a:b] = view[n]
                failed[a:b] = np.logical_or.reduce([rule(view, rest.limits) for rule in BASE_RULES.values()])
                good = np.flatnonzero(~failed[a:b])
                kept[a + good[rest.passes(view.take(~failed[a:b]))]] = True
            columns = [*batch.columns, *(pa.array(got[n]) for n in added[:5]), pa.array(failed), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *added])

    return map_rows(source, score, T.StructType([*source.schema.fields, *kinds]))


def keep_good(docs: DataFrame, cascade: Cascade, text: str = "text") -> DataFrame:
    """The documents that no rule rejects, base rules included, unchanged."""

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [a + cascade.passes(View(chunk)) for a, _, chunk in chunks(batch.column(batch.schema.get_field_index(text)))]
            yield batch.take(pa.array(np.concatenate(kept) if kept else [], pa.int64()))

    return map_rows(docs, drop, docs.schema)
