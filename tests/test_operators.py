"""Operators on small tables."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.functions import normalize as N
from paperloom.operators import chunking, dedup, filters, fusion, joins, mutation, ordering, search, similarity, usage
from paperloom.plans import registry


def test_conditions_refuse_what_they_do_not_know(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    assert filters.where(df, []).count() == 2
    assert [r.n for r in filters.where(df, [{"field": "n", "op": "in", "value": [2]}]).collect()] == [2]
    for bad in ({"field": "x", "op": "eq", "value": 1}, {"field": "n; drop", "op": "eq", "value": 1}, {"field": "n", "op": "~", "value": 1}, {"field": "n", "op": "in", "value": []}):
        with pytest.raises(ValueError):
            filters.where(df, [bad])


def test_year_window_only_excludes_when_active(spark):
    df = spark.createDataFrame([("2020",), (None,)], "year string")
    assert filters.year_window(df, "soon").count() == 2
    assert filters.year_window(df, "2021-2019").count() == 1


def test_host_suffixes(spark):
    df = spark.createDataFrame([("https://a.b.org/x",), ("https://ab.org",), (None,)], "url string")
    left = filters.drop_hosts(df, spark.createDataFrame([("b.org",)], "host string"))
    assert [r.url for r in left.collect()] == ["https://ab.org", None]
    assert filters.drop_hosts(df, spark.createDataFrame([], "host string")).count() == 3


def articles(spark):
    rows = [(1, "10.1/A", "Short", "x", 3, 2020, ["a"]), (2, "doi:10.1/a", "A longer title", "", 9, 0, ["b", "a"]), (3, None, "Twin", "y", 0, 1999, ["a"]), (4, None, "Twin", "y", 0, 1999, ["c"])]
    return spark.createDataFrame(rows, "ord int, doi string, title string, journal string, citations int, year int, sources array<string>")


def test_merge_keeps_rows_without_a_key(spark):
    got = {r.ord: r for r in dedup.merge_articles(articles(spark), N.doi("doi"), fill=["journal"], long=["title"]).collect()}
    assert sorted(got) == [1, 3, 4]
    assert (got[1].title, got[1].journal, got[1].citations, got[1].year, got[1].sources) == ("A longer title", "x", 9, 2020, ["a", "b"])


def test_merge_is_idempotent(spark):
    once = dedup.merge_articles(articles(spark), N.doi("doi"), fill=["doi", "journal"], long=["title"]).drop("n_merged")
    twice = dedup.merge_articles(once, N.doi("doi"), fill=["doi", "journal"], long=["title"]).drop("n_merged")
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.select(once.columns).collect()))


def test_first_whole_drops_rows_without_a_key(spark):
    df = spark.createDataFrame([(1, "k", "a"), (2, "k", "b"), (3, None, "c")], "ord int, k string, source string")
    assert [(r.ord, r.sources) for r in dedup.first_whole(df, F.col("k")).collect()] == [(1, ["a", "b"])]


def test_rrf_does_not_depend_on_channel_order(spark):
    rows = [("v", 1, 1), ("v", 2, 2), ("t", 2, 1), ("t", 3, 2)]
    a, b = (fusion.rrf(spark.createDataFrame(x, "channel string, id int, rank int"), ["id"]).orderBy("id").collect() for x in (rows, rows[::-1]))
    assert a == b and a[1].score == pytest.approx(1 / 62 + 1 / 61)


def test_failed_chunk_does_not_block_its_item(spark):
    v = spark.createDataFrame([(1, 7, 1, 0.1), (2, 7, 2, 0.9)], "id int, item_id int, rank int, similarity double")
    x = spark.createDataFrame([(3, 8, 1)], "id int, item_id int, rank int")
    got = fusion.hybrid_items(v, x, 0.7, 10).collect()
    assert [(r.item_id, r.id) for r in got] == [(8, 3), (7, 2)]


def test_leader_groups_match_a_fold(spark):
    rng = random.Random(4)
    edges = sorted({(a, b) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(70)) if a < b})
    pairs = spark.createDataFrame([(a, b, 0.9) for a, b in edges], "a int, b int, similarity double")
    got = {r.member: r.leader for r in search.leader_groups(spark, pairs, lambda x: x.persist()).collect()}
    near = set(edges)
    leaders, want = [], {}
    for v in sorted({x for e in edges for x in e}):
        own = [x for x in leaders if (x, v) in near]
        if own:
            want[v] = own[0]
        else:
            leaders.append(v)
    assert got == want


def test_as_of_takes_the_last_at_or_before(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "g int, at int")
    right = spark.createDataFrame([(1, 2, 10), (1, 5, 20), (2, 10, 30)], "g int, at int, v int")
    assert {(r.g, r.at): r.v for r in joins.as_of(left, right, "g", "at", "v").collect()} == {(1, 5): 20, (1, 1): None, (2, 9): None}


def test_or_key_lookup_gives_every_match(spark, tmp_path):
    # supplier 10001 has the same key as supplier 1 by its second; rows of one key and name count once
    spark.createDataFrame([(1, "a"), (10001, "b"), (2, "c"), (2, "c"), (2, "d"), (None, "n")], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(7, 1, 1), (8, 1, 2), (9, 2, 3), (10, 5, 1), (11, None, 1), (12, 10001, 1)], "l_orderkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted((r.l_orderkey, r.s_name) for r in registry.or_key_lookup(spark, str(tmp_path)).collect())
    con = pytest.importorskip("duckdb").connect()
    for name in ("supplier", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted((r[0], r[2]) for r in con.execute(registry.ORACLE_SQL["or_key_lookup"]).fetchall())
    assert got == want == [(7, "a"), (8, "a"), (8, "b"), (9, "c"), (9, "d"), (10, None), (11, None), (12, "a"), (12, "b")]


def test_insert_absent(spark):
    table = spark.createDataFrame([(1, "a")], "k int, v string")
    rows = spark.createDataFrame([(1, "x", 1), (2, "y", 2), (2, "z", 3), (None, "n", 4), (None, "m", 5)], "k int, v string, ord int")
    new, said = mutation.insert_absent(table, rows, ["k"], "ord")
    assert [r.status for r in said.orderBy("ord").collect()] == ["ignored", "inserted", "ignored", "inserted", "inserted"]
    assert new.count() == 4


def test_sections_and_chunks_cover_the_text(spark):
    text = "Title line\n1. Introduction\n" + "A sentence here. " * 300 + "\nReferences\n[1] x"
    rows = chunking.chunk(spark.createDataFrame([(1, text), (2, None), (3, "plain " * 700)], "doc_id long, text string")).collect()
    own = [r for r in rows if r.doc_id == 1]
    assert [r.category for r in own if r.category != "intro"] == ["header", "references"]
    for a, b in zip(own, own[1:]):
        assert a.category != b.category or a.start < b.start <= a.end
    assert all(text[r.start : r.end] == r.chunk_text and len(r.chunk_text) <= chunking.SIZE for r in own)
    assert not [r for r in rows if r.doc_id == 2]
    plain = [r for r in rows if r.doc_id == 3]
    assert plain[0].start == 0 and plain[-1].end == 4200 and {r.category for r in plain} == {"fallback"}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the tables are not here")
def test_table_function_gives_the_same_chunks(spark):
    d = "/root/testdata/sf0.001"
    want = sorted(map(tuple, registry.chunk_documents(spark, d).collect()))
    assert sorted(map(tuple, registry.lateral_chunks(spark, d).collect())) == want and want
    chunking.register(spark)
    some = spark.createDataFrame([(1, None), (2, ""), (3, "Abstract\nWe show.\nReferences\n[1]")], "id int, text string")
    got = spark.sql("SELECT id, c.category FROM {some}, LATERAL text_chunks(text) c ORDER BY id, chunk_index", some=some).collect()
    assert [tuple(r) for r in got] == [(3, "abstract"), (3, "references")]


def test_pack_is_greedy_within_groups(spark):
    df = spark.createDataFrame([("a", 1, 6), ("a", 2, 5), ("a", 3, 5), ("b", 1, 99), ("b", 2, 1)], "g string, o int, n int")
    got = {(r.g, r.o): r.batch for r in chunking.pack(df, "g", "o", "n", 10).collect()}
    assert got == {("a", 1): 0, ("a", 2): 1, ("a", 3): 1, ("b", 1): 0, ("b", 2): 1}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the tables are not here")
def test_titles_sort_by_collation(spark):
    """First words of real texts, some upper-cased, against the same rules by hand: letters, then accents, then case."""
    import unicodedata

    words = {w for r in registry.t(spark, "/root/testdata/sf0.01", "documents").select(F.regexp_extract("text", r"^([\p{L}]+)", 1).alias("w")).collect() if (w := r.w) and not set(w.lower()) & set("ßæœøłı")}
    words |= {w.upper() for w in sorted(words)[::3]} | {"apple", "Apple", "äpfel", "apfel", "Apfel", "ñandú", "nandu", "Zebra", "zebra", "éa", "eb"}

    def key(w):
        split = unicodedata.normalize("NFD", w)
        letters = [c for c in split if not unicodedata.combining(c)]
        marks = [[]]
        for c in split[1:]:
            marks[-1].append(c) if unicodedata.combining(c) else marks.append([])
        return "".join(letters).lower(), marks, [c.isupper() for c in letters]

    rows = spark.createDataFrame([(i, w) for i, w in enumerate(sorted(words))], "ord int, title string")
    got = [r.title for r in rows.orderBy(*ordering.display_order("title")).collect()]
    assert got == sorted(words, key=key) and got != sorted(words) and len(got) > 100
    spanish = [r.title for r in rows.filter("title in ('nandu', 'ñandú', 'Zebra')").orderBy(*ordering.display_order("title", collation="es")).collect()]
    assert spanish == ["nandu", "ñandú", "Zebra"]


def test_pack_of_one_long_group_equals_a_fold(spark, monkeypatch):
    monkeypatch.setattr(chunking, "PIECE_ROWS", 40)
    rng = random.Random(8)
    rows = [("a", i, rng.choice([0, 1, 2, 3, 5, 8, 30, None]), {"x": i}) for i in range(900)] + [(None, i, rng.randrange(9), None) for i in range(50)] + [("z", i, 0, None) for i in range(130)]
    df = spark.createDataFrame(rows, "g string, o int, n int, more struct<x:int>").repartition(6)
    for budget in (0, 10, 57, 10_000):
        want, state = {}, {}
        for g, o, n, _ in rows:
            batch, used = state.get(g, (0, None))
            n = n or 0
            batch, used = (batch, n) if used is None else (batch + 1, n) if used + n > budget else (batch, used + n)
            state[g] = batch, used
            want[g, o] = batch
        out = chunking.pack(df, "g", "o", "n", budget, lambda x: registry.stored(spark, x)).collect()
        assert len(out) == len(rows) and {(r.g, r.o): r.batch for r in out} == want
        assert all(r.more.x == r.o for r in out if r.g == "a")


def test_as_of_in_pieces(spark):
    rng = random.Random(9)
    left = spark.createDataFrame([(rng.randrange(3), rng.randrange(200)) for _ in range(150)] + [(None, 5)], "g int, at int").distinct()
    right = spark.createDataFrame([(rng.randrange(2), k, None if k % 7 == 0 else k) for k in rng.sample(range(200), 60)] + [(None, 3, 9)], "g int, at int, v int")
    plain = sorted(map(tuple, joins.as_of(left, right, "g", "at", "v").collect()), key=str)
    assert sorted(map(tuple, joins.as_of(left, right, "g", "at", "v", F.floor(F.col("at") / 20)).collect()), key=str) == plain


def test_display_order(spark):
    df = spark.createDataFrame([(1, "On graph neural nets", "2020", 5), (2, "Graph-neural work", "2021", None), (3, "Other", None, 9)], "ord int, title string, year string, citations int")
    order = lambda kind: [r.ord for r in df.orderBy(*ordering.display_order(kind, "graph neural")).collect()]
    assert (order("relevance"), order("date"), order("citations"), order("title")) == ([1, 2, 3], [2, 1, 3], [3, 1, 2], [2, 1, 3])


def test_ivf_recall(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(10 * (i % 5 == j), 1) for j in range(5)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    clusters = search.ivf_fit(df)
    found = search.ivf_search(df, clusters, df.filter("vec_id % 20 = 0"), 10).collect()
    assert len(clusters.centres) == 30 and clusters.probes < 30 and len(found) == 150
    for q in (0, 40, 280):
        exact = {r.vec_id for r in search.nearest(df.filter(f"vec_id <> {q}"), rows[q][1], 10).collect()}
        assert len(exact & {r.vec_id for r in found if r.query_id == q}) >= 9


def test_ivf_recall_of_the_registered_query(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("the tables are not here")
    v = {r.vec_id: r.embedding for r in registry.t(spark, "/root/testdata/sf0.001", "embeddings").collect()}
    ids, m = np.array(sorted(v)), np.array([v[i] for i in sorted(v)])
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    found = {}
    for r in registry.ivf_topk(spark, "/root/testdata/sf0.001").collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for q in ids[ids % 20 == 0]:
        cos = unit @ unit[ids == q][0]
        cos[ids == q] = -2
        hits.append(len(found[q] & set(ids[np.argsort(-cos)[:10]])) / 10)
    assert len(hits) == 25 and np.mean(hits) >= 0.9


def test_insert_under_several_keys(spark):
    rng = random.Random(3)
    table = [(None, "a0", "b0"), (None, "a1", None)]
    rows = [(i, rng.choice([f"a{rng.randrange(40)}", None]), f"b{rng.randrange(60)}") for i in range(120)]
    seen, want = {("x", "a0"), ("y", "b0"), ("x", "a1")}, {}
    for i, x, y in rows:
        keys = {(n, v) for n, v in (("x", x), ("y", y)) if v}
        want[i] = "ignored" if keys & seen else "inserted"
        seen |= keys if want[i] == "inserted" else set()
    schema = "ord int, x string, y string"
    got = mutation.insert_absent_any(spark.createDataFrame(table, schema), spark.createDataFrame(rows, schema), [["x"], ["y"]], "ord", lambda d: registry.stored(spark, d))
    assert {r.ord: r.status for r in got.collect()} == want


def test_tree_of_any_depth(spark):
    nodes = spark.range(45).select(F.col("id").alias("k"), F.when(F.col("id") > 0, F.col("id") - 1).alias("p"), F.concat(F.lit("n"), F.col("id")).alias("name"))
    loop = spark.createDataFrame([(100, 101, "x"), (101, 100, "y")], "k long, p long, name string")
    got = ordering.flatten_tree(spark, nodes.union(loop), "k", "p", "name", lambda d: registry.stored(spark, d)).collect()
    assert sorted((r.id, r.depth) for r in got) == [(i, i) for i in range(45)]


def test_duplicates_are_found_across_labels_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(search, "CHUNK_ROWS", 16)
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)], i % 3) for i in range(80)] + [(i, [1.0, 0.5, 0.0, 0.0, 0.0, 0.0], i % 3) for i in range(80, 120)] + [(120, [0.0] * 6, 0), (121, [0.0] * 6, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    v = [[float(x) for x in r.embedding] for r in df.orderBy("vec_id").collect()]
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    want = {(a, b) for a in range(122) for b in range(a + 1, 122) if (n := (dot(v[a], v[a]) * dot(v[b], v[b])) ** 0.5) and dot(v[a], v[b]) / n >= 0.6}
    got = [(r.a, r.b) for r in search.similar_pairs(df, 0.6).collect()]
    assert len(got) == len(want) and set(got) == want
    within = [(r.a, r.b) for r in search.similar_pairs(df, 0.6, F.col("label")).collect()]
    assert sorted(within) == sorted((a, b) for a, b in want if a % 3 == b % 3)
    leaders, member = [], {}
    for b in range(122):
        if own := [a for a in leaders if (a, b) in want]:
            member[b] = own[0]
        else:
            leaders.append(b)
    groups = similarity.leaders(df, 0.6, lambda x: registry.stored(spark, x)).collect()
    assert len(groups) == len(member) and {r.member: r.leader for r in groups} == member


def test_duplicate_queries_lose_no_label(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("the tables are not here")
    assert registry.duplicate_pairs_all(spark, "/root/testdata/sf0.001").count() > registry.duplicate_pairs(spark, "/root/testdata/sf0.001").count()
    label = {r.vec_id: r.label for r in registry.t(spark, "/root/testdata/sf0.001", "embeddings").collect()}
    assert any(label[r.leader] != label[r.member] for r in registry.duplicate_groups(spark, "/root/testdata/sf0.001").collect())


def test_lists_hold_values_not_rows(spark):
    rows = spark.range(2000).select(F.col("id").alias("ord"), F.lit("k").alias("k"), F.array(F.concat(F.lit("s"), (F.col("id") % 3).cast("string"))).alias("sources"))
    merged = dedup.merge_articles(rows, F.col("k"), long=[], most=[], least=[])
    assert [(r.ord, r.n_merged, r.sources) for r in merged.collect()] == [(0, 2000, ["s0", "s1", "s2"])]
    events = spark.range(2000).select(F.when(F.col("id") >= 0, "q").alias("query"), F.lit(1.0).alias("score"), F.col("id").alias("host"))
    learnt = usage.learnt_queries(events, "query", "score", "host")
    assert [(r.mean_score, r.n, r.hosts) for r in learnt.collect()] == [(1.0, 2000, [0, 1, 2, 3, 4])]
    plan = learnt._jdf.queryExecution().executedPlan().toString() + merged._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "collect_list(struct(o, ord" not in plan


def test_whole_texts_are_keys(spark, tmp_path):
    rows = [(1, "a" * 250 + " x", "en", "s1"), (2, "a" * 250 + " y", "en", "s2"), (3, "short", "en", "s3"), (4, "short", "en", "s4"), (5, None, "en", "s5")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: registry.QUERIES[name](spark, str(tmp_path)).collect()
    assert sorted((r.ord, r.n_merged, r.sources) for r in run("dedup_sources_whole")) == [(1, 1, "s1"), (2, 1, "s2"), (3, 2, "s3,s4"), (5, 1, "s5")]
    assert sorted((r.ord, r.sources) for r in run("dedup_first_whole")) == [(1, "s1"), (2, "s2"), (3, "s3,s4")]
    assert sorted((r.n, r.queries) for r in run("query_tokens_whole")) == [(0, 1), (1, 2), (2, 2)]


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
def test_packing_against_a_plain_fold(spark):
    rows = sorted((r.source, r.doc_id, r.n_chars) for r in registry.t(spark, DATA, "documents").collect())
    want, now = {}, {}
    for source, doc, n in rows:
        batch, used = now.get(source, (0, 0))
        if source in now and used + n > 20_000:
            batch, used = batch + 1, 0
        now[source], want[doc] = (batch, used + n), batch
    assert {r.doc_id: r.batch for r in registry.pack_batches(spark, DATA).collect()} == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
def test_chunks_of_the_whole_table(spark):
    texts = {r.doc_id: r.text for r in registry.t(spark, DATA, "documents").collect()}
    by = {}
    for r in registry.chunk_documents(spark, DATA).collect():
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {i for i, t in texts.items() if (t or "").strip()}
    for i, chunks in by.items():
        chunks.sort(key=lambda r: r.chunk_index)
        assert [r.chunk_index for r in chunks] == list(range(len(chunks)))
        held = bytearray(len(texts[i]))
        for k, r in enumerate(chunks):
            assert r.chunk_text == texts[i][r.start : r.end] and r.end - r.start <= (1500 if r.category == "fallback" else 2000)
            held[r.start : r.end] = b"x" * (r.end - r.start)
            if k and r.category == "fallback":  # chunks begin 200 characters before the last one's end, which is a sentence's where there is one
                last = chunks[k - 1]
                assert r.start == max(last.end - 200, last.start + 1)
                tail = texts[i][last.start + 750 : last.start + 1500]
                sentence = r"(?:[.!?\u3002\uff01\uff1f]\s|\n)"
                ends = bool(re.search(sentence + "$", texts[i][last.start : last.end]))
                assert ends or (last.end - last.start == 1500 and not re.search(sentence, tail))
        lost = [c for c, h in zip(texts[i], held) if not h and c.strip()]
        if chunks[0].category == "fallback":
            assert not lost


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
def test_duplicate_groups_of_the_whole_table(spark):
    v = {r.vec_id: r.embedding for r in registry.t(spark, DATA, "embeddings").collect()}
    ids = sorted(v)
    m = np.array([v[i] for i in ids], np.float64)
    cos = (m @ m.T) / np.linalg.norm(m, axis=1)[:, None] / np.linalg.norm(m, axis=1)[None]
    leaders, want = [], {}
    for k in range(len(ids)):
        own = [x for x in leaders if cos[x, k] >= 0.4]
        if own:
            want[ids[k]] = ids[own[0]]
        else:
            leaders.append(k)
    assert {r.member: r.leader for r in registry.duplicate_groups(spark, DATA).collect()} == want and want
