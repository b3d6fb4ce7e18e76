"""Query texts, query sets, and the item score."""

from pyspark.sql import functions as F

from paperloom.functions import dialects as D
from paperloom.functions import scoring as C


def test_source_queries():
    assert D.arxiv("graphs") == "all:graphs"
    assert D.arxiv("graphs", author="Li", title='a "b"', year="2020-2021") == 'all:graphs au:Li AND ti:"a b" AND submittedDate:[202001010000 TO 202112312359]'
    assert D.europe_pmc("q") == "q" and D.europe_pmc("q", reviews=True) == "(q) AND pub_type:Review"
    assert D.pubmed("q", title="t", has_abstract=True) == '(q) AND ("t")[Title] AND hasabstract[Filter]'
    assert D.openalex("a b", open_access=True) == "title.search:a%20b,open_access.is_oa:true"
    assert (D.github("q", "t"), D.github("q", " "), D.plain("q", "t"), D.plain("q")) == ("q in:title", "q", "t", "q")


def test_expansion_is_bounded_and_starts_with_the_query():
    got = D.expand("graph neural network models 模型", frozenset({"models"}))
    assert got[0].startswith("graph") and len(got) == 8 and "neural latest advances" in got
    assert D.expand("深度学习")[1] == "深度 systematic review"


def test_alike_queries_are_one():
    assert D.distinct_queries(["deep learning", "Deep Learning ", "deep learning review", "protein folding", "", "a"]) == ["deep learning review", "protein folding", "a"]
    assert D.distinct_queries([]) == []


def test_item_quality(spark):
    score = lambda *a: spark.range(1).select(C.item_quality(*(F.lit(x) if x is not None else F.lit(None).cast("double") for x in a))).first()[0]
    assert score(9, 1, "journalArticle", "x" * 300, True, 9.0, 0, False) == 58
    assert score(9, 1, "journalArticle", "x" * 300, True, 9.0, 0, True) == 51
    assert score(0, 50, "preprint", "", False, None, 0, False) == 18


def test_core_lists_and_json(spark):
    df = spark.createDataFrame([({"CSSCI扩展": "1", "北大核心": "是", "CSCD": "-"}, 'so: ```json\n{"a": 1}\n``` done'), ({}, "{bad"), (None, 'x {"b": {"c": 2}} y')], "m map<string,string>, t string")
    got = df.select(C.core_lists("m"), C.json_object("t")).collect()
    assert [(sorted(a) if a is not None else None, b) for a, b in got] == [(["cssci", "pku"], '{"a": 1}'), ([], None), (None, '{"b": {"c": 2}}')]


def test_full_text_choice(spark):
    df = spark.createDataFrame([("short", "y" * 200), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(C.full_text_choice(F.col("a"), F.col("b"), most=150)).collect()] == ["y" * 150, None]
