"""Phrase mining against plain counting, and each of its steps."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from paperloom.llm import phrases
from paperloom.llm.textkernel import buffers


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def pieces(text):
    return [w for p in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)) if (w := re.findall("[^ \t]+", p))]


def plain(docs, most=3, least=10, top=2000):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    out = []
    for lang in n:
        own = {p: c for (x, p), c in f.items() if x == lang and c >= least}
        best = []
        for p, a in own.items():
            if len(p) > 1 and not any(len(q) > len(p) and 100 * c >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, c in own.items()):
                score, _, l, r = min((10**6 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top])]
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    words = ["a", "b", "A", "é", "É", "漢字", "c d", "e", "\x00", " ", "new", "york", "times"]
    texts = ["".join(rng.choice(words) + rng.choice(["", " ", " ", " ", "  ", "\t", ". ", ",", "\n", " \r\n", "\x0b", ";"]) for _ in range(rng.randrange(60))) for _ in range(150)]
    texts += [None, "", " .. ,", "new york times " * 30, "a a a a a a a a", "x" * 3000]
    return [(t, rng.choice(["en", "de", None, ""])) for t in texts]


@pytest.mark.parametrize("most", [2, 3, 4])
def test_mining_equals_plain_counting(spark, most):
    data = corpus(most)
    got = phrases.mine(spark, spark.createDataFrame(data, "text string, lang string").repartition(5), words=most)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == plain(data, most)


def test_ranking_in_steps(spark):
    rows = [("en" if i % 4 else "de", f"p{i} q", (i * 7919) % 90, i % 5) for i in range(3000)]
    df = spark.createDataFrame(rows, "lang string, phrase string, score long, a long")
    want = {(r.lang, r.phrase): r.rank for r in phrases._first(df, 100, 1).collect()}
    assert {(r.lang, r.phrase): r.rank for r in phrases._first(df, 100, 37).collect()} == want and len(want) == 200


def test_normal_text_has_guarded_words():
    for text, _ in corpus(9):
        data, offsets = buffers(pa.array([text, "next", None, "One, two"]))
        many, out = phrases._normal(data, offsets)
        want = [w for t in (text, "next", None, "One, two") for w in pieces(t)]
        assert out.tobytes().decode() == "".join(" " + " ".join(w) + " \n" for w in want) and many == sum(map(len, want))


def test_equal_hashes_are_told_apart(monkeypatch):
    """All phrases under one hash: counts come from the texts themselves."""
    raw = b" a b \n a b a b \n"
    own = phrases.Windows("en", raw, 3, 20)
    own.sorted[:] = 7
    got = dict(zip(*own.counted(np.ones(len(own.cell), bool))))
    assert got == {"a": 3, "b": 3, "a b": 3, "b a": 1, "a b a": 1, "b a b": 1}


def test_cells_travel_whole():
    rng = np.random.default_rng(1)
    for many in (1, 5, 5000):
        cells = np.unique(rng.integers(0, 1 << phrases.RANGE_BITS, many))
        assert (phrases._spread(pa.scalar(phrases._squeezed(cells)), len(cells)) == cells).all()


def test_empty_table_and_clashing_columns(spark):
    schema = T.StructType([T.StructField(c, T.StringType() if c in ("text", "lang") else T.LongType()) for c in ("doc_id", "text", "lang", "shard", "f", "phrase", "a `b")])
    assert phrases.mine(spark, spark.createDataFrame([], schema)).collect() == []
    got = phrases.mine(spark, spark.createDataFrame([(1, "a b", None, 2, 3, 4, 5)] * 12, schema)).collect()
    assert [(r.lang, r.phrase, r.a, r.n) for r in got] == [("und", "a b", 12, 24)]
