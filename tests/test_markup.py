"""Feeds, articles and page texts."""

from paperloom.sources import markup

FEED = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><title>all</title>
<entry><id>http://arxiv.org/abs/1</id><title>A  &amp; B
 title</title><author><name>Li</name></author><author><name>Ou</name></author><summary> Text </summary><published>2021-02-03T00:00:00Z</published><arxiv:doi>10.1/X</arxiv:doi><link href="h" rel="alternate"/><link href="http://p.df" title="pdf"/></entry>
<entry><id>2</id><title> </title></entry></feed>"""
ARTICLE = "<article><front><article-meta><abstract><p>We show.</p></abstract></article-meta></front><body><sec><title>2. Methods</title><p>First <i>step</i>.</p><sec><title>Data</title><p>Rows.</p></sec></sec><sec><title>Odd</title><p>x</p></sec></body><back><ref-list><ref>One 2020</ref></ref-list></back></article>"


def test_atom(spark):
    got = markup.atom_records(spark.createDataFrame([(FEED,), (None,), ("no feed",)], "xml string")).collect()
    assert [tuple(r) for r in got] == [("http://arxiv.org/abs/1", "A & B title", "Li, Ou", "Text", 2021, "10.1/x", "http://p.df")]


def test_article_sections(spark):
    assert markup.xml_sections(ARTICLE) == [("abstract", "abstract", "We show."), ("method", "2. Methods", "First step."), ("method", "Data", "Rows."), ("other", "Odd", "x"), ("references", "references", "One 2020")]
    assert markup.xml_sections("<broken") == []
    df = markup.xml_chunks(spark.createDataFrame([(1, ARTICLE), (2, None)], "id int, xml string"))
    assert df.count() == 5 and [r.id for r in markup.bears_methods(df, "id").collect()] == [1]


def test_packing():
    assert markup.pack_paragraphs("aaaa\n\nbbbb\ncccc", 9) == ["aaaa\nbbbb", "cccc"]
    assert markup.pack_paragraphs("x" * 20 + "\ny", 9) == ["x" * 20, "y"]


def test_garbage(spark):
    texts = ["short", "plain words " * 20, "a{b:c;}" * 40, "{{x}} y " * 30]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(markup.is_page_garbage("t")).collect()] == [True, False, True, True]
