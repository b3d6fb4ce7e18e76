"""Sources, plans and streams on small inputs."""

import json

from pyspark.sql import functions as F

from paperloom.operators import risk
from paperloom.plans import domains, literature
from paperloom.sources import datasets, recorded
from paperloom.streaming import feeds


def test_tuple_files(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"year": 2025, "data": [["Nature", "1", 64.8], ["Cell", "x", None], ["Short"]]}))
    rows = datasets.read_tuples(spark, str(tmp_path / "m.json"), [("name", "string"), ("rank", "int"), ("jif", "double")]).orderBy("name").collect()
    assert [tuple(r) for r in rows] == [(2025, "Cell", None, None), (2025, "Nature", 1, 64.8), (2025, "Short", None, None)]


def test_csv_with_quotes_and_line_breaks(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b,c\n"x ""y""","1/333","2 区"\r\n"two\nlines",N/A,-\n')
    df = datasets.read_csv(spark, str(tmp_path / "x.csv"), ["a", "b", "c"]).select("a", datasets.rank_of("b"), datasets.zone("c"))
    assert sorted(map(tuple, df.collect())) == [("two\nlines", None, None), ('x "y"', 1, 2)]


def test_upsert_lines_keeps_what_it_does_not_own(spark):
    df = spark.createDataFrame([("note\nIF: 1\nmine: x",), (None,)], "e string")
    out = [r[0] for r in df.select(datasets.upsert_lines("e", {"if": F.lit("2.5"), "Zone": F.lit(None).cast("string")})).collect()]
    assert out == ["if: 2.5\nnote\nmine: x", "if: 2.5"]


def payloads(spark):
    rows = [("figshare", 0, {"id": "1", "title": "A", "doi": "10.1/x", "year": "2020"}), ("osf", 0, {"id": "9", "title": "B", "year": "2021"}), ("dryad", 0, {"id": "2", "title": "A again", "doi": "https://doi.org/10.1/X", "year": "2019"}), ("figshare", 1, {"title": "no key", "year": "2020"})]
    return spark.createDataFrame([(s, o, json.dumps(p)) for s, o, p in rows], "source string, ord long, payload string")


def test_domain_search_reports_what_it_left_out(spark):
    rows, said = domains.search(spark, payloads(spark), "dataset", 50, chosen=["figshare", "osf", "dryad", "kaggle", "uci"], failures={"osf": "HTTP 429"})
    assert {(r.source, r.state, r.reason) for r in said.collect()} == {("figshare", "ok", None), ("dryad", "ok", None), ("uci", "ok", None), ("kaggle", "skipped", "key"), ("osf", "failed", "rate-limited")}
    got = rows.collect()
    assert [(r.dedup_key, r.sources) for r in got] == [("10.1/x", ["dryad", "figshare"])]


def test_domain_search_without_a_capable_source(spark):
    rows, said = domains.search(spark, payloads(spark), "dataset", 5, {"country": "fr"}, chosen=["osf"])
    assert rows.count() == 0 and [(r.state, r.reason) for r in said.collect()] == [("skipped", "filter")]


def test_every_connector_maps_the_empty_payload(spark):
    for name, c in recorded.CONNECTORS.items():
        row = c.rows(spark.createDataFrame([(0, "{}")], "ord long, payload string")).schema
        assert "dedup_key" in row.names, name


def test_enrichers(spark):
    df = spark.createDataFrame([("us-1234567-b2", {"status": "Inactive", "amount": "1234567", "start": "2020", "works": "30", "phases": "1,2"})], "dedup_key string, metrics map<string,string>")
    assert domains.patent_status(df).first().status == "granted"
    g = domains.grant(df).first()
    assert (g.status, g.amount, g.term) == ("completed", "$1,234,567", None)
    assert domains.researcher(df).first().status == "active" and domains.trial(df).first().phase == "1/2"


def test_risk_layers(spark):
    items = spark.createDataFrame([(1, "X", None, "https://www.bad.org/a"), (2, "fake  journal of bio", None, None), (3, "Q", "Evil Press", None), (4, "Applied Junk Robotics", None, None), (5, "Letters Junk Robotics Applied Things", None, None), (6, None, None, None), (7, "Fine", None, None)], "id int, journal string, publisher string, url string")
    journals = spark.createDataFrame([("Fake Journal of Bio", "http://bad.org", None), ("Junk Robotics Things", None, "AJR")], "name string, url string, abbr string")
    publishers = spark.createDataFrame([("EVIL PRESS", None)], "name string, url string")
    got = {r.id: (r.layer, r.confidence) for r in risk.check(items, journals, publishers, spark.createDataFrame([], "name string, url string")).collect()}
    assert got == {1: ("url", 1.0), 2: ("exact", 1.0), 3: ("exact", 1.0), 4: ("abbr", 0.9), 5: ("keyword", 0.7), 6: (None, None), 7: (None, None)}


def test_deep_search_grows_queries_and_never_repeats_a_paper(spark):
    def fetch(queries):
        q = queries.select("query", "round")
        return q.select("query", F.concat(F.lit("https://nature.com/"), F.col("query")).alias("url"), F.lit(None).cast("string").alias("doi"), F.concat("query", F.lit(" deeper topic of interest")).alias("title"), F.lit("x" * 500).alias("abstract"), F.lit(10).alias("citations"))

    scores = spark.createDataFrame([], "key string, ai_score int")
    papers, buckets = literature.deep_search(spark, ["graphs", "Graphs "], fetch, scores, lambda x: x.persist(), rounds=3, threshold=10)
    got = papers.collect()
    assert len({r.key for r in got}) == len(got) == 2  # the third round's query was asked already
    assert sum(buckets.first()) == 2


def test_upsert_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, o int").coalesce(1).write.parquet(f"{tmp_path}/in")
    table, last = feeds.Snapshots(spark, f"{tmp_path}/out", "k int, v string, o int"), []
    step = feeds.upserts(table, ["k"], "o")
    for rows in ([], [(2, "c", 3)]):
        if rows:
            spark.createDataFrame(rows, "k int, v string, o int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        feeds.run(feeds.files(spark, f"{tmp_path}/in", "k int, v string, o int"), f"{tmp_path}/ckpt", lambda b, n: (step(b, n), last.append(n)))
    assert sorted((r.k, r.v) for r in table.read(max(last)).collect()) == [(1, "a"), (2, "c")]


def test_watermarked_usage_is_a_stream(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 10:00:00' ts, 'a' event_type, 1.0D value").write.parquet(f"{tmp_path}/in")
    stream = feeds.daily_usage(feeds.files(spark, f"{tmp_path}/in", "ts timestamp, event_type string, value double"))
    assert stream.isStreaming and stream.columns == ["day", "event_type", "n", "total"]


def test_review_queries(spark):
    rows = [(2, "Uses of DeepLearning and X", ["a", "graph networks"], None), (1, None, None, "protein folding"), (3, "DeepLearning AlphaFold2 AlphaFold", ["t1", "t2", "t3", "t4", "t5", "t6"], "y" * 61)]
    reviews = spark.createDataFrame(rows, "ord int, title string, tags array<string>, domain string")
    got = [tuple(r) for r in literature.review_signals(reviews).orderBy("ord", "k").select("signal", "ord").collect()]
    assert got == [("protein folding", 1), ("graph networks", 2), ("DeepLearning", 2), *((f"t{i}", 3) for i in range(1, 6)), ("AlphaFold", 3)]
    out = literature.review_queries(reviews.filter("ord < 3"), "review")
    assert out == ["protein folding review", "graph networks review", "DeepLearning review"]
    assert literature.review_queries(reviews.limit(0), "review") == []


# one item of each service, in the form of its public payloads: (payload, id, title, authors, year, key, a metric)
PAYLOADS = {
    "openalex": ({"id": "https://openalex.org/W1", "display_name": "T", "authorships": [{"author": {"display_name": "A"}}, {"author": {"display_name": "B"}}], "publication_year": 2020, "doi": "https://doi.org/10.1/X", "cited_by_count": 7}, "https://openalex.org/W1", "T", "A; B", "2020", "10.1/x", ("citations", "7")),
    "crossref": ({"DOI": "10.1/X", "title": ["T"], "author": [{"family": "A"}, {"family": "B"}], "issued": {"date-parts": [[2019, 5]]}, "is-referenced-by-count": 3, "container-title": ["J"]}, "10.1/X", "T", "A; B", "2019", "10.1/x", ("journal", "J")),
    "europe-pmc": ({"id": "1", "title": "T", "authorString": "A, B", "pubYear": "2018", "doi": "10.1/x", "citedByCount": 2, "isOpenAccess": "Y"}, "1", "T", "A, B", "2018", "10.1/x", ("openAccess", "Y")),
    "semantic-scholar": ({"paperId": "p", "title": "T", "authors": [{"name": "A"}], "year": 2021, "externalIds": {"DOI": "10.1/x"}, "citationCount": 9}, "p", "T", "A", "2021", "10.1/x", ("citations", "9")),
    "doaj": ({"id": "d", "bibjson": {"title": "T", "author": [{"name": "A"}], "year": "2017", "identifier": [{"id": "10.1/x"}], "journal": {"title": "J"}}}, "d", "T", "A", "2017", "10.1/x", ("journal", "J")),
    "hal": ({"docid": "5", "title_s": ["T"], "authFullName_s": ["A", "B"], "producedDateY_i": 2016, "doiId_s": "10.1/x"}, "5", "T", "A; B", "2016", "10.1/x", None),
    "zenodo": ({"id": 4, "metadata": {"title": "T", "creators": [{"name": "A"}], "publication_date": "2015-02-03", "license": {"id": "cc-by-4.0"}}, "doi": "10.5281/z"}, "4", "T", "A", "2015", "10.5281/z", ("license", "cc-by-4.0")),
    "datacite-search": ({"id": "10.1/x", "attributes": {"titles": [{"title": "T"}], "creators": [{"name": "A"}], "publicationYear": 2014, "doi": "10.1/x", "publisher": "P"}}, "10.1/x", "T", "A", "2014", "10.1/x", ("publisher", "P")),
    "huggingface": ({"id": "o/d", "author": "o", "downloads": 5, "tags": ["a", "b"], "lastModified": "2023-01-01"}, "o/d", "o/d", "o", "2023", "hf:o/d", ("tags", "a,b")),
    "nih": ({"appl_id": 11, "project_title": "T", "contact_pi_name": "A", "fiscal_year": 2022, "award_amount": 10}, "11", "T", "A", "2022", "nih:11", ("amount", "10")),
    "clinicaltrials": ({"protocolSection": {"identificationModule": {"nctId": "NCT1", "briefTitle": "T"}, "statusModule": {"overallStatus": "COMPLETED", "startDateStruct": {"date": "2012-01"}}, "designModule": {"phases": ["PHASE1", "PHASE2"]}, "sponsorCollaboratorsModule": {"leadSponsor": {"name": "A"}}}}, "NCT1", "T", "A", "2012", "clinicaltrials:NCT1", ("phases", "PHASE1/PHASE2")),
    "openalex-author": ({"id": "A1", "display_name": "N", "works_count": 120, "last_known_institutions": [{"display_name": "I", "country_code": "FR"}]}, "A1", "N", "N", None, "oa-author:A1", ("country", "FR")),
    "dblp": ({"info": {"key": "k", "title": "T", "authors": {"author": [{"text": "A"}, {"text": "B"}]}, "year": "2011", "doi": "10.1/x"}}, "k", "T", "A; B", "2011", "dblp:k", None),
    "google-patents": ({"publication_number": "US1234567B2", "title": "T", "inventor": "A", "publication_date": "2010-01-01", "assignee": "C"}, "US1234567B2", "T", "A", "2010", "us-1234567-b2", ("applicants", "C")),
    "serper": ({"link": "http://x", "title": "T", "snippet": "s", "date": "Jan 2009"}, "http://x", "T", None, "2009", "web:http://x", None),
    "exa": ({"url": "http://x", "title": "T", "author": "A", "publishedDate": "2008-01-01", "score": 0.5}, "http://x", "T", "A", "2008", "web:http://x", ("score", "0.5")),
}


def test_connectors_read_their_services_payloads(spark):
    import json

    rows = spark.createDataFrame([(s, i, json.dumps(p[0])) for i, (s, p) in enumerate(PAYLOADS.items())], "source string, ord long, payload string")
    got = {r.source: r for r in recorded.result_rows(rows, list(PAYLOADS)).collect()}
    for s, (_, sid, title, authors, year, key, metric) in PAYLOADS.items():
        r = got[s]
        assert (r.source_id, r.title, r.authors, r.year, r.dedup_key) == (sid, title, authors, year, key), s
        assert metric is None or r.metrics[metric[0]] == metric[1], s
