"""Text operators against brute force, with their edge cases."""

import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperloom.llm import html_extract, line_dedup, minhash, mixing, oracles, quality_rules, sentencepiece, skew
from paperloom.llm.textkernel import chunks

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [None, "", " \n\t ", "one", "one two", "A b\nA b\n\nA b", "é漢字 x y", "w " * 3000, "x" * 5000, "a\n" * 200]


def rows(texts, start=0):
    return [(i + start, t, None, f"s{i % 3}" if i % 4 else None, None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    return duckdb.connect()


def oracle(duck, sql, data):
    import pandas as pd

    duck.register("documents", pd.DataFrame(data, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"text": "object", "source": "object"}))
    return [tuple(None if v is None or v != v else v for v in r) for r in duck.execute(sql).fetchall()]


def made(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_kernel_words_and_lines():
    rng = random.Random(1)
    texts = EDGE + ["".join(rng.choice("aBé漢 \n\t\x0b.") for _ in range(rng.randrange(80))) for _ in range(300)]
    for limit in (16, 1 << 20):
        for a, b, c in chunks(pa.array(texts), limit=limit):
            line = c.lines()
            for i in range(a, b):
                t = texts[i] or ""
                s = slice(c.word_at[i - a], c.word_at[i - a + 1])
                assert [bytes(c.data[x:y]).decode() for x, y in zip(c.start[s], c.end[s])] == WORD.findall(t)
                assert [bytes(c.data[x:y]).decode() for x, y, d in zip(*line) if d == i - a] == [x for x in t.split("\n") if WORD.search(x)]


def rule_columns(text):
    t = text or ""
    w = WORD.findall(t)
    grams = {}
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    hit = {i + j for at in grams.values() if len(at) > 1 for i in at for j in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_quality_rules_against_brute_force(spark):
    rng = random.Random(2)
    words = ["Ab", "cd", "é", "x#", "YY!!", "|", "longer"]
    data = rows(EDGE + [made(rng, words[: rng.randrange(2, 8)], rng.randrange(200)) for _ in range(60)])
    docs = spark.createDataFrame(data + data[:3], DOCS).withColumn("kept", F.lit("clash"))
    cascade = quality_rules.plan_cascade(docs, rules=tuple(quality_rules.RULES))
    got = quality_rules.assess(docs.select("doc_id", "text", "kept"), cascade).collect()
    assert len(got) == len(data) + 3
    for r in got:
        want = rule_columns(data[r.doc_id][1])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    # the order of the rules changes no verdict, and the stage keeps the same rows
    back = quality_rules.Cascade(cascade.order[::-1])
    assert {(r.doc_id, r.kept) for r in quality_rules.assess(docs.select("doc_id", "text"), back).collect()} == {(r.doc_id, r.kept) for r in got}
    kept = quality_rules.keep_good(docs, quality_rules.plan_cascade(docs))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)
    assert kept.columns == docs.columns
    assert quality_rules.assess(docs.filter("false"), cascade).count() == 0


def test_line_dedup_against_sql(spark, duck):
    rng = random.Random(3)
    lines = [made(rng, ["aa", "b", "ccc", "d"], n) for n in (60, 55, 30, 25, 20, 5, 1, 1)] + ["", " "]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 9))) for _ in range(80)] + EDGE
    data = rows(texts)
    docs = spark.createDataFrame(data, DOCS)
    got = sorted(map(tuple, line_dedup.drop_repeats(spark, docs.select("doc_id", "text"), counts=True).collect()), key=str)
    assert got == sorted(oracle(duck, oracles.LINE_DEDUP, data), key=str)
    assert any(r[3] for r in got)


def test_line_dedup_of_many_lines_and_repeated_rows(spark):
    lines = [f"line {i} of a long text" for i in range(20_000)]
    text = "\n".join(lines + lines[:5000])
    docs = spark.createDataFrame([(1, text)] + [(2, "w " * 60)] * 500 + [(3, "w " * 60)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.drop_repeats(spark, docs).dropDuplicates().collect()}
    assert got == {1: "\n".join(lines), 2: "w " * 60, 3: ""}


def test_line_dedup_edges(spark):
    passage = "p " * 60
    data = [(None, passage), (5, passage), (5, passage), (3, "head\n" + passage + "\ntail"), (4, passage + "\n" + passage)]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("line", F.lit(1)).withColumn("_id", F.lit(2))
    got = line_dedup.drop_repeats(spark, docs)
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == sorted([("None", ""), ("5", ""), ("5", ""), ("3", data[3][1]), ("4", "")])
    assert line_dedup.drop_repeats(spark, docs.filter("false")).count() == 0


def test_mixing_against_sql(spark, duck):
    rng = random.Random(4)
    data = [(i, made(rng, ["a", "bb"], rng.randrange(1, 90)), None, rng.choice(["z", "z", "z", "b", "c", "ä", None]), None) for i in range(400)] + [(1000 + i, t, None, None, None) for i, t in enumerate(EDGE)]
    docs = spark.createDataFrame(data, DOCS)
    got = sorted((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.assess(spark, docs).collect())
    want = sorted((a, b, c, round(d, 6), e) for a, b, c, d, e in oracle(duck, oracles.MIXING, data))
    assert got == want
    by = {}
    for (_, size, total, target, taken), d in zip(got, sorted(data)):
        x = by.setdefault(d[3], [target, 0, total, 0])
        x[1], x[3] = x[1] + taken, max(x[3], size)
        assert taken <= 3 * size
    assert all(abs(t - s) <= most for t, s, _, most in by.values())
    assert sum(x[0] for x in by.values()) == pytest.approx(sum(x[2] for x in by.values()))
    again = mixing.mix(spark, docs.withColumn("_size", F.lit("mine")))
    assert again.columns == [*docs.columns, "_size"]
    assert again.filter(F.regexp_count("text", F.lit(mixing.WORD)) > 0).count() == sum(g[4] // g[1] for g in got if g[1])


def test_mixing_edges(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mixing.assess(spark, empty).count() == 0
    one = spark.createDataFrame([(1, "a b", None, "s", None), (1, "a b", None, "s", None), (None, None, None, None, None)], DOCS)
    assert sorted(str(tuple(r)) for r in mixing.assess(spark, one).collect()) == sorted(["(1, 2, 4, 4.0, 2)"] * 2 + ["(None, 0, 0, 0.0, 0)"])


def near_reference(data, k, percent):
    sets = {}
    for d, t in data:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    low = {d: d for d in sets}

    def top(a):
        while low[a] != a:
            a = low[a]
        return a

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                low[y] = x
    return {d: (len(sets[d]), top(d)) for d in ids}


def edited(rng, words, text, share):
    return " ".join(rng.choice(words) if rng.random() < share else w for w in text.split(" "))


@pytest.mark.parametrize("counted", [True, False])
def test_near_duplicates_against_brute_force(spark, monkeypatch, counted):
    if not counted:  # the blocks alone must find all
        whole = minhash.collisions
        monkeypatch.setattr(minhash, "collisions", lambda postings: whole(postings).filter("false"))
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 900)
    monkeypatch.setattr(minhash, "PIECE", 8)
    monkeypatch.setattr(skew, "LEAST_HOT", 4)
    monkeypatch.setattr(skew, "HOT_SHARE", 1 / 50)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = list(EDGE)
    for _ in range(12):
        base = made(rng, words, rng.randrange(5, 120))
        texts += [edited(rng, words, base, rng.choice([0, 0.02, 0.05, 0.1])) for _ in range(rng.randrange(1, 9))] + [base.upper()]
    drift = made(rng, words, 80)
    for _ in range(60):  # a chain in which distant copies are unlike
        drift = edited(rng, words, drift, 0.03)
        texts.append(drift)
    rng.shuffle(texts)
    data = list(enumerate(texts))
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("c", F.lit(None).cast("int"))
    for k, percent in ((2, 80), (5, 80)) if counted else ((2, 80),):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark, docs, words=k, percent=percent).collect()}
        assert got == near_reference(data, k, percent)


@pytest.mark.parametrize("counts", [[3] + [2] * 7, [40] + [2] * 7, [2] * 8, [3], []])
def test_even_and_uneven_keys_take_one_way(spark, monkeypatch, tmp_path, counts):
    monkeypatch.setattr(skew, "LEAST_HOT", 1)
    monkeypatch.setattr(skew, "HOT_SHARE", 1 / 4)
    spark.createDataFrame([(k, i) for k, n in enumerate(counts) for i in range(n)] + [(-1, 0)], "k long, i long").write.parquet(f"{tmp_path}/rows")
    spark.createDataFrame([(k, k + 0.5, n) for k, n in enumerate(counts)], "k long, x double, many long").write.parquet(f"{tmp_path}/table")
    out = skew.join_counted(spark.read.parquet(f"{tmp_path}/rows"), spark.read.parquet(f"{tmp_path}/table"), ["k"])
    assert sorted(map(tuple, out.collect())) == [(k, i, k + 0.5) for k, n in enumerate(counts) for i in range(n)]
    # a most frequent key goes by broadcast even if none has a quarter of the rows, so the anti join is there
    ran = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert ("LeftAnti" in ran) == (len(counts) == 8 and counts[0] > 2)


def test_near_duplicates_edges(spark):
    docs = spark.createDataFrame([(None, "a b c"), (2, "a b c"), (2, "a b c"), (1, "a  B c"), (9, None), (9, "z y")], "doc_id long, text string")
    got = sorted(map(str, map(tuple, minhash.near_duplicates(spark, docs, words=2).collect())))
    assert got == sorted(map(str, [(None, 2, None, True), (2, 2, 1, False), (2, 2, 1, False), (1, 2, 1, True), (9, 0, 9, True), (9, 1, 9, True)]))
    assert minhash.near_duplicates(spark, docs.filter("false")).count() == 0


def test_recall_of_candidates_at_the_threshold():
    """Pairs at similarity 0.8 that agree on enough coordinates, over many random pairs."""
    rng = np.random.Generator(np.random.PCG64(4))
    met = []
    for _ in range(2000):
        both, one, two = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (80, 10, 10))
        least = lambda x: np.array([((f := x * a + b) ^ (f >> np.uint64(32))).min() for a, b in zip(minhash._A, minhash._B)])
        met.append((least(np.append(both, one)) == least(np.append(both, two))).sum())
    assert np.mean(np.array(met) >= minhash.MATCHES) > 0.998 and 0.78 < np.mean(met) / minhash.COORDINATES < 0.82


# ---- SentencePiece

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def bpe():
    return sentencepiece.Model.load(TOKENIZER)


def test_bpe_equals_the_public_decoder(bpe):
    import sentencepiece as spm

    own = spm.SentencePieceProcessor(model_file=TOKENIZER)
    rng = random.Random(6)
    parts = list("abcdefghinorstu   .,!?\n\té漢字𝔘THE()[]01") + ["the", "ing", " and ", "   ", "▁", "====", "https://"]
    texts = [t for t in EDGE if t is not None] + ["".join(rng.choice(parts) for _ in range(rng.randrange(70))) for _ in range(600)] + [" " * n for n in (1, 2, 15, 16, 17, 40)]
    assert bpe.encode(pa.array(texts)).to_pylist() == own.encode(texts)
    assert bpe.decode(bpe.encode(pa.array(texts))).to_pylist() == [t.replace("▁", " ") for t in texts]


def test_long_words_equal_the_public_decoder(bpe):
    import time

    import sentencepiece as spm

    rng = random.Random(9)
    own = spm.SentencePieceProcessor(model_file=TOKENIZER)
    words = ["".join(rng.choice(kind) for _ in range(n)) for kind in ("abcdefghij", "aA0+/", "the ing".replace(" ", ""), "é漢z", "=") for n in (191, 192, 193, 400, 3000)]
    assert bpe.encode(pa.array(words + [f"a {w} b" for w in words])).to_pylist() == own.encode(words + [f"a {w} b" for w in words])
    base64 = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(20_000))
    began = time.perf_counter()
    bpe.encode(pa.array([base64]))
    assert time.perf_counter() - began < 2


def test_scored_search_takes_the_largest_sum():
    own = sentencepiece.Model.load(TOKENIZER, scored=True)
    rng = random.Random(10)
    lost = float(own.scores[own.kinds == 0].min()) - 10.0
    for _ in range(40):
        word = "\u2581" + "".join(rng.choice("theinganorsd") for _ in range(rng.randrange(1, 14)))
        best = [0.0] + [-np.inf] * len(word)
        for j in range(1, len(word) + 1):
            for i in range(j):
                value = own.rank.get(word[i:j], lost if j == i + 1 else -np.inf)
                best[j] = max(best[j], best[i] + value)
        ids = own.encode(pa.array([word[1:]])).to_pylist()[0]
        assert "".join(own.pieces[i] for i in ids) == word and abs(sum(own.scores[i] for i in ids) - best[-1]) < 1e-2


@pytest.mark.parametrize("byte_pieces", [True, False])
def test_unigram_equals_the_public_decoder(tmp_path, byte_pieces):
    import sentencepiece as spm
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback, m.trainer_spec.unk_id = 1, byte_pieces, 0
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = "identity", True, False, True
    rng = random.Random(7)
    names = ["<unk>", "<s>", "</s>"] + [f"<0x{b:02X}>" for b in range(256)] * byte_pieces
    for n in names:
        m.pieces.add(piece=n, score=0, type={"<unk>": 2, "<s>": 3, "</s>": 3}.get(n, 6))
    seen = {"▁", *"abcde"} | {"▁" * (rng.random() < 0.4) + "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 6))) for _ in range(120)}
    for p in sorted(seen):
        m.pieces.add(piece=p, score=-rng.random() * 10 - 1, type=1)
    (tmp_path / "u.model").write_bytes(m.SerializeToString())
    own, lib = sentencepiece.Model.load(str(tmp_path / "u.model")), spm.SentencePieceProcessor(model_file=str(tmp_path / "u.model"))
    texts = ["".join(rng.choice("abcde   zé") for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    got, want = own.encode(pa.array(texts)).to_pylist(), lib.encode(texts)
    if byte_pieces:
        assert got == want
    else:  # an unknown piece stands for each unknown stretch of a word
        squeeze = lambda ids: [x for i, x in enumerate(ids) if x or not i or ids[i - 1]]
        assert list(map(squeeze, got)) == list(map(squeeze, want))


def test_encoding_on_spark_keeps_other_columns(spark, bpe):
    docs = spark.createDataFrame(rows(EDGE), DOCS).withColumn("ids", F.lit("clash"))
    out = sentencepiece.decode(sentencepiece.encode(docs, bpe), bpe)
    got = sorted(out.collect(), key=lambda r: r.doc_id)
    assert [r.decoded for r in got] == EDGE and got[0].ids is None and got[1].ids == []
    assert set(out.columns) == {*docs.columns, "decoded"}
    assert sentencepiece.encode(docs.filter("false"), bpe).count() == 0
    with pytest.raises(ValueError):
        bpe.decode(pa.array([[10**6]], pa.list_(pa.int32())))


# ---- HTML


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""),
        ("", ""),
        ("<p", ""),
        ("plain &amp; simple text", "plain & simple text"),
        ("<article><h1>T</h1><p>Hi <i>there</i>you<br>now<p>Second  line<ul><li>one<li>two</ul></article>", "T\nHi thereyou now\nSecond line\none\ntwo"),
        ("<nav><ul><li><a href=/a>Home</a></ul></nav><main><p>Some real text, that matters.</p><form><label>x</label><input></form><aside>See also</aside></main><footer>&copy; me", "Some real text, that matters."),
        ("<article><p>Body text of some length here.</p><div class='comments'><p>I liked this post a lot, really.</p></div></article>", "Body text of some length here."),
        ("<script>var a='<p>x</p>'</script><style>p{}</style><!-- <p>no</p> --><p>a &lt;b&gt; &#233;&nbsp;c</p><div id=cookie-notice>We use cookies here.</div>", "a <b> é c"),
        ("<div class='content with-sidebar'><p>Kept, though a name says sidebar.</p></div><div class=sidebar><p>Dropped words</p></div>", "Kept, though a name says sidebar."),
        ("<article class='ad-free'><p>A normal paragraph of some words.</p></article>", "A normal paragraph of some words."),
        ("<div id='register-guide'><p>How to register, in some steps.</p></div>", "How to register, in some steps."),
        ("<body><div class='side-by-side'><p>Two columns of text here.</p></div></body>", "Two columns of text here."),
        ("<div class='blog-comments-enabled'><p>The post itself is here.</p></div>", "The post itself is here."),
        ("<article><p>First words of it.</p><div class='related-work'><p>Others did this before.</p></div></article>", "First words of it.\nOthers did this before."),
        ("<div><p>Before it, some words are said.</p><p>Read <a href=x>this linked sentence of ours</a></p><p>After it, some words are said.</p></div>", "Before it, some words are said.\nRead this linked sentence of ours\nAfter it, some words are said."),
        ("<article><p>Text of it.</p><ul class='tags-list'><li>one</li><li>two</li></ul></article>", "Text of it.\none\ntwo"),
        ("<p>Energy is <math><mi>E</mi><mo>=</mo><mi>mc</mi></math> here in the text.</p>", "Energy is E=mc here in the text."),
        ("<header><p>The site's own words, which lead.</p></header><article><header><h1>Title</h1></header><p>Text of it.</p></article>", "Title\nText of it."),
        ("<div class='site-nav'><ul><li>Home<li>About</ul></div><p>Text of it is here.</p><section class='comment-list'><p>I liked it all a lot, thank you so much, really.</p></section>", "Text of it is here."),
        ("<article><p>Text of it.</p><div id='comments'><div class='comment-body'><p>" + "I liked it all a lot, thank you so much. " * 20 + "</p></div></div></article>", "Text of it."),
        ("<div class='modal-content'><main><p>All of the page is in here.</p><p>And more of it too.</p></main></div>", "All of the page is in here.\nAnd more of it too."),
        ("<div class=top><a href=1>Home</a> <a href=2>About us</a></div><article><p>Text of it is here, and more.</p></article><div>Our motto</div>", "Text of it is here, and more."),
        ("<div><a>Home</a></div><div><a>News</a></div><div><a>Shop</a></div><p>Words of the page, as they are.</p>", "Words of the page, as they are."),
        ("</div></p></b><p>a</i> b</p></article>", "a b"),
        ("<p hidden>no</p><div style='display: none'><p>no</p></div><p>yes, this one.", "yes, this one."),
    ],
)
def test_main_text(html, text):
    assert html_extract.main_text(html) == text


def test_minimum_cut_against_all_labellings():
    rng = random.Random(8)
    for _ in range(60):
        n = rng.randrange(1, 8)
        cost = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.random() * 2) for a in range(n) for b in range(a) if rng.random() < 0.5]
        price = lambda keep: sum(max(c, 0) if not k else max(-c, 0) for c, k in zip(cost, keep)) + sum(w for a, b, w in edges if keep[a] != keep[b])  # noqa: E731, B023
        best = min(price([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert price(html_extract.minimum_cut(cost, edges)) == pytest.approx(best)


def test_extraction_on_spark(spark):
    pages = spark.createDataFrame([(1, "u", "<p>Hello, world.</p>"), (None, None, None)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = html_extract.extract(pages).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in got] == [(1, "Hello, world.", 13), (None, "", 0)]
    assert html_extract.extract(pages.filter("false")).count() == 0


def test_whole_long_page():
    html = "<article>" + "".join(f"<p>Paragraph {i} with words.</p>" for i in range(3000)) + "</article>"
    assert html_extract.main_text(html).count("\n") == 2999


@pytest.mark.parametrize("html", ["<div>" * 8000 + "</b></i></p>" * 4000, "<b>" * 8000 + "<p>x" * 8000, "<div class=ad>" * 6000 + "<p>x</p>" * 6000, ("<div>" * 50 + "x" + "</div>" * 49 + "y") * 200])
def test_deep_pages_take_linear_time(html):
    import time

    began = time.perf_counter()
    html_extract.main_text(html)
    assert time.perf_counter() - began < 4


def test_precision_and_recall_over_the_pages():
    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.01/pages.parquet"
    html = pq.read_table(path, columns=["html"])["html"].to_pylist() if os.path.exists(path) else []
    kept = wanted = right = 0
    for h in html:  # in these pages the article is the one article element
        inside = re.search(r"<article>(.*?)</article>", h, re.S)[1]
        want = [w for w in html_extract.unescape(re.sub(r"<[^>]*>", " ", inside)).split()]
        got = html_extract.main_text(h).split()
        both = sum((Counter(want) & Counter(got)).values())
        kept, wanted, right = kept + len(got), wanted + len(want), right + both
    assert not html or (right >= 0.999 * wanted and right >= 0.999 * kept)


def test_edges_overturn_costs():
    blocks = html_extract.read_blocks("<div><p>Some words of a page.</p><p>See <a>some more of these linked words</a></p><p>Some words of a page.</p></div>")
    cost = html_extract.content_costs(blocks)
    assert cost[1] < 0 and html_extract.minimum_cut(cost, list(html_extract._edges(blocks))) == [True] * 3


def test_digest_is_stable(bpe):
    ids = bpe.encode(pa.array(["The quick brown fox\n jumps"])).to_pylist()[0]
    assert hashlib.sha256(str(ids).encode()).hexdigest() == hashlib.sha256(str(bpe.encode(pa.array(["x", "The quick brown fox\n jumps"])).to_pylist()[1]).encode()).hexdigest()


def test_round_trip_in_one_pass_equals_both_steps(spark, bpe):
    text = F.when(F.col("doc_id") == 4, F.repeat(F.lit("long \u2581words\n"), 400_000)).otherwise(F.col("text"))  # over one slice
    rows = [(1, "a few words", "x", [7]), (2, None, None, None), (3, "", "y", []), (4, "", "z", None), (1, "a few words", "x", [7])]
    docs = spark.createDataFrame(rows, "doc_id int, text string, decoded string, ids array<int>").coalesce(1).withColumn("text", text)
    both, steps = sentencepiece.round_trip(docs, bpe), sentencepiece.decode(sentencepiece.encode(docs, bpe), bpe)
    seen = [sorted(map(tuple, df.select("doc_id", F.md5("text"), F.size("ids"), F.xxhash64("ids"), F.md5("decoded"), F.translate("text", sentencepiece.SPACE, " ").eqNullSafe(F.col("decoded"))).collect()), key=str) for df in (both, steps)]
    assert seen[0] == seen[1] and len(seen[0]) == 5 and all(r[-1] for r in seen[0])
    assert sentencepiece.round_trip(docs.limit(0), bpe).collect() == []
