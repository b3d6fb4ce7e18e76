"""Reading of pages: tags against a reader that goes character by character, and what is left out."""

import random

import pytest
from pyspark.sql import types as T

from paperloom.llm import html_extract
from paperloom.llm.html_extract import main_text


def slow_tag(html, at):
    """(name, attributes, end) of a start tag at ``<``, by the states of the standard's tokeniser."""
    i, n = at + 1, len(html)
    while i < n and not html[i].isspace() and html[i] not in "/>":
        i += 1
    name, found = html[at + 1 : i].lower(), {}
    while i < n:
        if html[i].isspace() or html[i] == "/":
            i += 1
        elif html[i] == ">":
            return name, found, i + 1
        else:
            start = i
            i += 1
            while i < n and not html[i].isspace() and html[i] not in "/>=":
                i += 1
            key, value, j = html[start:i].lower(), "", i
            while j < n and html[j].isspace():
                j += 1
            if j < n and html[j] == "=":
                i = j + 1
                while i < n and html[i].isspace():
                    i += 1
                if i < n and html[i] in "\"'":
                    end = html.find(html[i], i + 1)
                    value, i = (html[i + 1 :], n) if end < 0 else (html[i + 1 : end], end + 1)
                else:
                    start = i
                    while i < n and not html[i].isspace() and html[i] != ">":
                        i += 1
                    value = html[start:i]
            found.setdefault(key, value)
    return name, found, n


def test_tags_as_the_slow_reader():
    rng = random.Random(1)
    for _ in range(20_000):
        html = "<p" + "".join(rng.choice(["'", '"', "=", " ", "/", ">", "a", "b", "\n", "a='x'", ' c="y"', "=z"]) for _ in range(rng.randrange(14)))
        name, found, end = slow_tag(html, 0)
        m = html_extract._TOKEN.match(html)
        assert (m[2].lower(), m.end()) == (name, end), html
        assert html_extract._attributes(m[3]) == found, html


LONG = "This is the story that the page tells, at some length and in full."


@pytest.mark.parametrize(
    "inner,want",
    [
        ("<p class=a title=don't>" + LONG + "</p><p>" + LONG + "</p>", LONG + "\n" + LONG),
        ("<p>See <a href=/o'neil>this</a>. " + LONG + "</p>", "See this. " + LONG),
        ('<p class="a"">' + LONG + "</p>", LONG),
        ("<p>" + LONG + "<button><div>Subscribe now</div></button> It goes on.</p>", LONG + " It goes on."),
        ("<p>" + LONG + "<template><p>hidden</p></template></p>", LONG),
        ("<p>" + LONG + "<select><p>opt<option>a</select></p>", LONG),
        ("<p>" + LONG + "<svg><title>t</title><text>icon</text></svg></p>", LONG),
        ("<p>" + LONG + "<button></p>Send</button> It goes on.</p>", LONG + " It goes on."),
        ("<p>" + LONG + "<label>Name <input></label></p>", LONG),
        ("<!--><p>" + LONG + "</p>", LONG),
        ("<!-- > --!><p>" + LONG + "</p>", LONG),
        ("</3><p>" + LONG + " 1 < 2 > 0</p>", LONG + " 1 < 2 > 0"),
        ("<p>" + LONG + "<b title='a>b'>!</b></p>", LONG + "!"),
    ],
)
@pytest.mark.parametrize("around", ["article", "main", "div"])
def test_odd_markup(inner, want, around):
    assert main_text(f"<html><body><nav><a href=/>Home</a> <a href=/x>News</a></nav><{around}>{inner}</{around}><footer>Imprint</footer></body></html>") == want


def slow_least(mark, total):
    against, m = [0.0], mark
    while m is not None:
        if not (m.by_name and m.holds_main and 2 * m.words >= total):
            against.append(m.cost)
        m = m.outer
    return min(against)


def test_marks_and_distances_at_any_depth():
    """Furniture counts from any depth, words and main parts add up to all marks around them."""
    rng = random.Random(4)
    for _ in range(50):
        html = "".join(rng.choice(["<nav>", "</nav>", "<div class=sidebar>", "<div>", "</div>", "<main>", "</main>", "<form>", f"<p>{LONG}", "words "]) for _ in range(200))
        blocks = html_extract.read_blocks(html)
        total = sum(b.words for b in blocks)
        for b in blocks:
            m = b.element.mark
            while m is not None:
                inside = [x for x in blocks if any(y is m for y in around(x.element.mark))]
                assert m.words == sum(x.words for x in inside)
                m = m.outer
            assert html_extract._against(b.element.mark, total) == slow_least(b.element.mark, total)
    deep = "<nav>" + "<div>" * 3000 + f"<p>{LONG}</p>" + "</div>" * 3000 + f"</nav><div><p>{LONG} More.</p><p>{LONG}</p></div>"
    assert main_text(deep) == f"{LONG} More.\n{LONG}"


def around(mark):
    while mark is not None:
        yield mark
        mark = mark.outer


def test_odd_column_names(spark):
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("html", T.StringType()), T.StructField("a `b", T.StructType([T.StructField("c d", T.LongType()), T.StructField("e`", T.StringType())])), T.StructField("text", T.StringType())])
    rows = spark.createDataFrame([(1, f"<p>{LONG}</p>", (2, "x"), "old"), (2, None, None, None)], schema)
    got = html_extract.extract(rows).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in got] == [(1, LONG, len(LONG)), (2, "", 0)] and got[0]["a `b"]["c d"] == 2
    assert html_extract.extract(rows.limit(0)).collect() == []


def test_odd_columns_pass_through_the_other_operators(spark):
    from paperloom.llm import line_dedup, quality_rules, sentencepiece

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("a.`b", T.StructType([T.StructField("c d", T.LongType())])), T.StructField("n_lines", T.LongType())])
    rows = spark.createDataFrame([(1, "one two", (2,), 7), (2, None, None, None)], schema)
    model = sentencepiece.Model.load("/opt/tokenizers/piece_bpe_32k.model")
    back = sentencepiece.round_trip(rows, model).orderBy("doc_id").collect()
    assert [r["decoded"] for r in back] == ["one two", None] and back[0]["a.`b"]["c d"] == 2
    cascade = quality_rules.plan_cascade(rows)
    assert [r["a.`b"] and r["a.`b"]["c d"] for r in quality_rules.assess(rows, cascade).orderBy("doc_id").collect()] == [2, None]
    assert quality_rules.keep_good(rows, cascade).columns == rows.columns
    got = line_dedup.drop_repeats(spark, rows, counts=True)
    assert got.columns == ["doc_id", "text", "a.`b", "n_lines", "n_removed"] and {r.doc_id: r.n_lines for r in got.collect()} == {1: 1, 2: 0}
