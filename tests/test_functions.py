"""Expressions on small rows, one behaviour each."""

import pytest
from pyspark.sql import functions as F

from paperloom.functions import normalize as N
from paperloom.functions import scoring as C
from paperloom.functions import text as X
from paperloom.plans import catalog, registry


def one(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("x"))).collect()]


def test_identifiers(spark):
    assert one(spark, ["https://doi.org/10.1/AbC", "dx.doi.org/10.1/abc", "doi: 10.1/ABC", " 10.1/abc ", "", None], N.doi) == ["10.1/abc"] * 4 + [None] * 2
    assert one(spark, ["doi.org/10.1/A", "http://dx.doi.org/10.1/A"], N.doi_strict) == ["doi.org/10.1/A", "10.1/A"]
    assert one(spark, ["1234-567x", " ", None], N.issn) == ["1234567X", None, None]
    assert one(spark, [" the  Lancet ", ""], N.journal_name) == ["THE LANCET", None]
    assert one(spark, ["Patent No. US 9,999,999 B2", "EP1234567", "US 12", "特許第 JP1234567 号", None], N.patent) == ["us-9999999-b2", "ep-1234567", None, "jp-1234567", None]
    assert one(spark, ["https://WWW.Example.org/a", "ftp://x.y", None], N.host) == ["example.org", None, None]
    assert one(spark, ["CC BY-NC-SA 4.0", "cc-by-sa", "Public Domain", "MIT", ""], N.licence) == ["by-nc-sa", "by-sa", "cc0", "other", None]
    assert one(spark, ["q1", "N/A", None], N.quartile) == ["Q1", None, None]
    assert one(spark, ["published 2021-05", "none", None], N.year) == [2021, None, None]


def test_stage_key(spark):
    rows = spark.createDataFrame([("10.1/A", "https://x.org/p"), (None, "https://www.X.org/p/?q=1"), (None, "local"), (None, None)], "d string, u string")
    assert [r[0] for r in rows.select(N.stage_key("d", "u")).collect()] == ["doi:10.1/a", "url:x.org/p", "local", None]


def test_tokens_with_cjk(spark):
    assert one(spark, ["深度学习 GPT-4 模", "", "かな한국"], X.tokens) == [["深度", "度学", "学习", "gpt", "4", "模"], [], ["かな", "な한", "한국"]]
    assert one(spark, ["a b", "!", None], X.any_token_query) == ['"a" OR "b"', None, None]


def test_identifier_detection(spark):
    got = one(spark, ["https://doi.org/10.1234/AB.", "2101.00001v2", "PMID: 123", "123", "graph", None], X.identifier_query)
    assert [tuple(g) if g else None for g in got] == [("doi", "10.1234/ab"), ("arxiv", "2101.00001v2"), ("pmid", "123"), None, None, None]
    assert one(spark, ["10.1234/x", "123", "978-0-306-40615-7", "http://a.b", "some title"], X.identifier_type) == ["doi", "pmid", "isbn", "url", "title"]


def test_sections(spark):
    assert one(spark, ["1. Introduction", "II. Experiments", "Results and Discussion", "参考文献", "we discuss results", "x" * 70, None], X.section) == ["intro", "method", "results", "references", None, None, None]


def test_error_classes_differ(spark):
    said = ["request timed out", "HTTP 429", "HTTP 403", "ECONNRESET", None]
    assert one(spark, said, X.source_error) == ["timeout", "rate-limited", "http", "network", "network"]
    assert one(spark, said, X.domain_error) == ["timeout", "rate-limited", "auth", "network", "http"]


def test_similarity(spark):
    assert one(spark, ["Deep Learning!", "night", "", "a"], lambda c: F.round(X.title_similarity(c, F.lit("deep learning")), 3)) == [1.0, 0.133, 0.0, 0.0]  # "ni" of 4 and 11


def test_fold_query(spark):
    assert one(spark, ["single-cell_rna", "10.1234/a-b", " - x"], X.fold_query) == ["single cell rna", "10.1234/a-b", "- x"]


def test_inverted_abstract(spark):
    row = spark.createDataFrame([({"b": [1], "a": [0, 2]},)], "m map<string,array<int>>")
    assert row.select(X.abstract_text("m")).first()[0] == "a b a"


@pytest.mark.parametrize("works,level", [(101, "prolific"), (21, "active"), (1, "emerging"), (0, None)])
def test_researcher_level(spark, works, level):
    assert spark.range(1).select(C.researcher_level(F.lit(works))).first()[0] == level


def test_tier_takes_the_lower_ranking(spark):
    pick = lambda *a: spark.range(1).select(C.journal_tier(*map(F.lit, a))).first()[0]
    assert pick(True, "Q1", 1, True) == 0
    assert pick(False, "Q1", 2, False) == 22
    assert pick(None, "Q2", None, None) == 24
    assert pick(None, None, None, None) == 0


def test_inverted_text_stays_in_its_row(spark):
    texts = ["b a b  a\nc a", "", " ", "x", None, "a b a", "é a\u00a0a é", " ".join(f"w{i * i % 700}" for i in range(5000))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in rows.select("text", X.inverted_text("text").alias("m")).collect():
        want = {}
        for i, w in enumerate(r.text.split(" ") if r.text is not None else []):
            want.setdefault(w, []).append(i)
        assert r.m == (want if r.text is not None else None)


def test_inverted_abstracts_shuffle_no_word(spark, tmp_path):
    rows = spark.createDataFrame([(0, "b a b"), (1, ""), (2, None)], "doc_id long, text string")
    rows.unionByName(rows.filter("doc_id < 2")).write.parquet(f"{tmp_path}/documents.parquet")
    out = catalog.inverted_abstracts(spark, str(tmp_path))
    assert out.count() == 4 and "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_half_up_and_fusion(spark):
    assert spark.range(1).select(C.half_up(F.lit(-0.5)), C.fuse(F.lit(0), F.lit(90)), C.fuse(F.lit(50), F.lit(100))).first()[:] == (0, 50, 65)


def test_fusion_of_whole_numbers_is_exact(spark):
    rows = [(19.0, 144, 57), (67.0, 902, 318), (3.0, 298, 92), (14.0, 9, 13)]  # in doubles the second part of these is under its value
    got = spark.createDataFrame(rows, "ai double, h long, want long").select(C.fuse(F.col("ai"), F.col("h"), exact=True).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_score_fusion_rounds_halves_up(spark, tmp_path):
    spark.createDataFrame([(1, 19.0, 144), (2, 67.0, 902), (3, None, 1)], "event_id long, value double, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    assert sorted(r[:] for r in registry.score_fusion(spark, str(tmp_path)).collect()) == [(1, 57), (2, 318), (3, None)]


def test_cosine_of_nothing_is_zero(spark):
    assert spark.range(1).select(C.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))).first()[0] == 0.0


def test_short_numbers_round_by_their_exact_value(spark):
    from fractions import Fraction
    from math import floor

    got = spark.range(1000, 100_000).select("id", X.short_number("id").alias("s")).collect()
    for r in got:
        n = floor(Fraction(r.id / 1000) * 10 + Fraction(1, 2))
        assert r.s == f"{n // 10}.{n % 10}k"
    some = {n: X.short_number(F.lit(n)) for n in (0, 999, 999_999, 1_000_000, 1_250_000, 1_249_999, 10**12)}
    row = spark.range(1).select(*(c.alias(str(n)) for n, c in some.items())).first().asDict()
    assert row == {"0": "0", "999": "999", "999999": "1000.0k", "1000000": "1.0M", "1250000": "1.3M", "1249999": "1.2M", str(10**12): "1000000.0M"}
    sizes = spark.range(1).select(*(X.short_bytes(F.lit(n)) for n in (5, 1536, 3 * 2**20, 5 * 2**29))).first()
    assert list(sizes) == ["5 B", "1.5 KB", "3.0 MB", "2.5 GB"]


def test_token_counts_without_tokens(spark):
    texts = ["", None, "The the, then THE x", "漢字かな交じり a漢b 字", "漢 漢字 漢字漢字", "über the-end 12the the12"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    asked = ["the", "漢字", "漢", "字漢", "12the"]
    rows = df.select(X.tokens("text").alias("t"), X.token_count("text").alias("n"), *(X.token_times("text", a).alias(a) for a in asked)).collect()
    for r in rows:
        own = r.t or []
        assert r.n == len(own) and all(r[a] == own.count(a) for a in asked)


def test_calibration(spark):
    got = spark.range(1).select(X.calibrated_ratio(F.array(F.lit(2.0), F.lit(None).cast("double"), F.lit(-1.0), F.lit(100.0))).alias("x")).first().x
    assert abs(got - min(6, (4 * 0.7 + 2 * 0.3) * 0.7 + 30)) < 1e-9
