"""Ranked search against a plain walk over all documents, and its bounds."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from paperloom.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=20):
    docs = [(i, Counter(terms(t))) for i, t in docs if i is not None]
    docs = [(i, c) for i, c in docs if c]
    n_docs, words = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        if item is None:
            continue
        found = []
        for i, c in docs:
            m = 75 + 25 * c.total() * n_docs // words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def corpus(seed, n=400):
    rng = random.Random(seed)
    vocabulary = [f"t{int(rng.paretovariate(0.7))}" for _ in range(2000)] + ["É", "é", "漢字", "x-y", "A", "a"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(int(rng.paretovariate(0.6)) % 900)) for _ in range(n)]
    texts += [texts[5]] * 60 + [None, "", "...", "\x00a\x7fb"]
    docs = [(3 * i, t) for i, t in enumerate(texts)] + [(None, "t1 t2"), (9, "t1 t1 t1")]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(40)))) for i in range(30)] + [(90, None), (91, ""), (92, "nowhere"), (93, texts[5]), (93, "t1"), (None, "t1")]
    return docs, items


def test_search_equals_plain_walk(spark):
    docs, items = corpus(1)
    index = lexical.build(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(9))
    assert index.count() > 4
    got = lexical.search(spark, index, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == plain(docs, items)


def test_groups_of_queries_give_the_same(spark, monkeypatch):
    docs, items = corpus(2, 60)
    monkeypatch.setattr(lexical, "QUERIES", 7)
    index = lexical.build(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    got = lexical.search(spark, index, spark.createDataFrame(items, "item_id long, text string"), k=3)
    assert sorted(map(tuple, got.collect())) == plain(docs, items, 3)


def test_bounds_hold_and_skip_blocks():
    """No document scores over its block's bound; a threshold leaves out blocks and documents under it alone."""
    rng = random.Random(3)
    from paperloom.llm.textkernel import PUNCTUATION, chunks

    blocks = []
    for b in range(40):
        texts = [" ".join(rng.choice([f"b{b}w{rng.randrange(30)}", f"c{rng.randrange(60)}", "the"]) for _ in range(rng.randrange(1, 200))) for _ in range(20)]
        for a, e, chunk in chunks(pa.array(texts), breaks=PUNCTUATION):
            docs, words, head, body = lexical._block(np.arange(a, e) + 100 * b, chunk)
            blocks.append((docs, words, *(pa.ipc.open_stream(x).read_next_batch() for x in (head, body))))
    group = lexical._group([{"id": q, "text": f"the b{q}w1 b{q}w2 c1 c2 b{q + 1}w3"} for q in range(20)])
    group = lexical.replace(group, docs=sum(b[0] for b in blocks), words=sum(b[1] for b in blocks))
    group = lexical.replace(group, weight=group.times * 1000)
    everyone, none = np.arange(20), np.zeros(20, np.int64)
    best, skipped = np.zeros((20, 0), np.int64), 0
    bounds = []
    for _, _, head, body in blocks:
        bounds.append(group.bounds(head))
        query, _, score = group.scores(head, body, everyone, none, 20)
        top = np.zeros(20, np.int64)
        np.maximum.at(top, query, score)
        assert (top <= bounds[-1]).all()
        best = np.concatenate([best, top[:, None]], axis=1)
    threshold = best.max(axis=1)
    skipped = (np.array(bounds).T < threshold[:, None]).mean()
    assert skipped > 0.8


def test_empty_tables_and_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(spark, lexical.build(spark, none), items).collect() == []
    schema = T.StructType([T.StructField(c, T.StringType() if c == "text" else T.LongType()) for c in ("doc_id", "text", "block", "head", "q", "score", "a `b")])
    index = lexical.build(spark, spark.createDataFrame([(5, "a b", 1, 2, 3, 4, 5), (4, "b", 1, 2, 3, 4, 5), (6, "c d e", 1, 2, 3, 4, 5)], schema))
    assert lexical.search(spark, index, items.limit(0)).collect() == []
    got = lexical.search(spark, index, items).collect()
    assert [(r.item_id, r.rank, r.doc_id) for r in got] == [(1, 1, 5)] and got[0].score > 0
