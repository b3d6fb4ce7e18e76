"""Registered queries of library items, domains, journals and discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dialects
from ..functions import normalize as N
from ..functions import scoring as C
from ..functions import text as X
from ..operators import fusion, index, joins, library, memory, mutation, ordering, risk, search, setjoin, usage
from ..sources import datasets, markup, recorded
from . import domains, literature
from .registry import _BM25, _COS, _VEC, ASKED, QUERIES, kept_index, query, r, stored, t, vector_of

_before = set(QUERIES)

# ---- retrieval over a library


@query(f"""WITH {_BM25}, v AS (SELECT vec_id AS id, label AS item, {_COS} AS similarity FROM ({_VEC}), (SELECT v AS q FROM ({_VEC}) WHERE vec_id = 0) WHERE vec_id IN (SELECT doc_id FROM documents)),
vr AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, id) AS rank FROM v QUALIFY rank <= 50), tr AS (SELECT doc_id AS id, label AS item, row_number() OVER (ORDER BY bm DESC, doc_id) AS rank FROM bm JOIN embeddings ON vec_id = doc_id QUALIFY rank <= 50),
h AS (SELECT id, item, rank, similarity FROM vr UNION ALL SELECT id, item, rank, NULL FROM tr), hf AS (SELECT id, item, sum(1.0 / (rank + 60)) AS score, max(similarity) AS similarity FROM h GROUP BY ALL HAVING max(similarity) IS NULL OR max(similarity) >= 0.2),
hb AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, id) AS n FROM hf QUALIFY n = 1)
SELECT item AS item_id, id AS chunk_id, round(score, 8) AS score, left(text, 200) AS snippet, 'Brand#' || item AS title FROM hb JOIN documents ON doc_id = id WHERE item % 4 <> 3 ORDER BY score DESC, id LIMIT 8""")
def hybrid_search(spark, d):
    """Query to both legs, over-fetch, fusion, gate, best chunk, chunk and item rows; deleted items go."""
    e = t(spark, d, "embeddings")
    docs = t(spark, d, "documents")
    chunks = library.with_vectors(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("chunk_text"), F.col("lang").alias("section_name")), e.select(F.col("vec_id").alias("chunk_id"), "embedding"))
    q = vector_of(spark, d)
    own = e.select(F.col("vec_id").alias("id"), F.col("label").alias("item_id"))
    near = search.ranked(search.nearest(chunks, q, 50, "id"), [F.desc("similarity"), F.col("id")], 50).join(own, "id")
    hits = kept_index(spark, d, "chunks", docs.join(own.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")).bm25(ASKED, 50)
    text = search.ranked(hits, [F.desc("score"), F.col("id")], 50).join(own, "id").select("id", "item_id", "rank")
    fused = fusion.hybrid_items(near.select("id", "item_id", "rank", "similarity"), text, 0.2, 50)
    items = e.select(F.col("label").alias("item_id")).distinct().select("item_id", F.concat(F.lit("Brand#"), "item_id").alias("title"), F.lit("article").alias("type"), F.lit(None).cast("string").alias("doi"), (F.col("item_id") % 4 == 3).alias("deleted"))
    found = library.present(fused.withColumnRenamed("id", "chunk_id"), chunks, items)
    return found.orderBy(F.desc("score"), "chunk_id").limit(8).select("item_id", "chunk_id", r("score", 8).alias("score"), "snippet", "title")


@query(f"""WITH m AS (SELECT doc_id FROM labels WHERE quality = 1), s AS (SELECT vec_id, {_COS} AS c FROM ({_VEC}), (SELECT v AS q FROM ({_VEC}) WHERE vec_id = 0) WHERE vec_id IN (SELECT doc_id FROM m))
SELECT vec_id, round(c, 6) AS similarity, lang AS kind FROM (SELECT * FROM s WHERE c >= 0.1 ORDER BY c DESC, vec_id LIMIT 10) LEFT JOIN documents ON doc_id = vec_id""")
def scoped_search(spark, d):
    """A collection's items nearest to a query, with what is known of them."""
    e = t(spark, d, "embeddings")
    members = t(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("vec_id"))
    q = vector_of(spark, d)
    near = search.nearest(library.in_scope(e, members, "vec_id"), q, 10, threshold=0.1)
    return near.join(t(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.col("lang").alias("kind")), "vec_id", "left").select("vec_id", r("similarity", 6).alias("similarity"), "kind")


@query(f"""WITH s AS (SELECT vec_id, {_COS} AS c FROM ({_VEC}), (SELECT v AS q FROM ({_VEC}) WHERE vec_id = 7) WHERE vec_id <> 7 AND vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))
SELECT vec_id, round(c, 6) AS similarity, left(text, 100) AS preview FROM (SELECT * FROM s WHERE c >= 0.1 ORDER BY c DESC, vec_id LIMIT 10) LEFT JOIN documents ON doc_id = vec_id""")
def similar_notes(spark, d):
    """J16d: notes like one note; those in the trash and the note itself are out."""
    e = t(spark, d, "embeddings")
    live = e.filter("vec_id <> 7").join(t(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_anti")
    q = vector_of(spark, d, 7)
    near = search.nearest(live, q, 10, threshold=0.1)
    return near.join(t(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.left("text", F.lit(100)).alias("preview")), "vec_id", "left").select("vec_id", r("similarity", 6).alias("similarity"), "preview")


_HITS = "SELECT doc_id AS id, n_chars % 97 AS item_id, lang AS section, n_chars / 7::DOUBLE AS score FROM documents"


@query(f"""WITH h AS ({_HITS}), f AS (SELECT * FROM h WHERE section = 'en' ORDER BY score DESC, id LIMIT 150), b AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS n FROM f QUALIFY n = 1),
g AS (SELECT * FROM (SELECT * FROM h ORDER BY score DESC, id LIMIT 150) WHERE section = 'en'), c AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS n FROM g QUALIFY n = 1)
(SELECT 'early' AS filter, item_id, id, round(score, 4) AS score FROM b ORDER BY b.score DESC, id LIMIT 10) UNION ALL (SELECT 'late', item_id, id, round(score, 4) FROM c ORDER BY c.score DESC, id LIMIT 10)""")
def overfetched_items(spark, d):
    """Best chunk of each item out of an over-fetched list, section before and after the cut."""
    hits = t(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") % 97).alias("item_id"), F.col("lang").alias("section"), (F.col("n_chars") / 7).alias("score"))
    both = [library.best_chunks(hits, 10, "en", late).select(F.lit("late" if late else "early").alias("filter"), "item_id", "id", r("score").alias("score")) for late in (False, True)]
    return both[0].unionByName(both[1])


_RANKED = "SELECT row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank, doc_id, CASE WHEN doc_id % 9 = 0 THEN ' ' ELSE text END AS text, n_chars / 1000::DOUBLE AS score FROM documents QUALIFY rank <= 60"


@query(f"""WITH h AS ({_RANKED}), x AS (SELECT *, CASE WHEN trim(text) <> '' AND doc_id % 5 > 0 THEN (doc_id * 37 % 101) / 100::DOUBLE END AS rr FROM h)
SELECT doc_id, round(coalesce(rr, score), 4) AS score, FALSE AS rerank_unavailable FROM x ORDER BY rr DESC NULLS LAST, rank LIMIT 20""")
def reranked(spark, d):
    """J16e: recorded rerank scores replace the score; blank and unscored texts keep their order behind."""
    docs = t(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 9 == 0, " ").otherwise(F.col("text")).alias("text"), (F.col("n_chars") / 1000).alias("score"), "n_chars")
    hits = search.ranked(docs, [F.desc("n_chars"), F.col("doc_id")], 60).drop("n_chars")
    scores = hits.filter("doc_id % 5 > 0").select("rank", (F.pmod(F.col("doc_id") * 37, F.lit(101)) / 100).alias("rerank"))
    return library.rerank(hits, scores, True, 20).select("doc_id", r("score").alias("score"), "rerank_unavailable")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN left(regexp_replace(text, '<[^>]+>', ' ', 'g'), 2000) WHEN doc_id % 3 = 1 THEN left(trim(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) || chr(10) || lang, 2000)
ELSE left(concat_ws(chr(10), trim(left(text, 60)), 'A, B', '2020', nullif(trim(left(text, 1500)), ''), nullif(trim(source), ''), lang), 3000) END AS search_text FROM documents""")
def search_texts(spark, d):
    """What is embedded of notes, annotations and other items."""
    k = F.col("doc_id") % 3
    kind = F.when(k == 0, "note").when(k == 1, "annotation").otherwise("article")
    made = library.search_text(kind, F.left("text", F.lit(60)), F.array(F.lit("A"), F.lit(" "), F.lit("B")), F.lit("2020-05-01"), F.col("text"), F.col("source"), F.array("lang"), F.col("text"), F.col("lang"))
    return t(spark, d, "documents").select("doc_id", made.alias("search_text"))


@query("SELECT (SELECT count(*) FROM embeddings WHERE label < 5) = 250 AS valid UNION ALL SELECT FALSE UNION ALL SELECT TRUE")
def index_validity(spark, d):
    """Stored indexes against their vectors: by count, by dimension, and one that agrees."""
    e = t(spark, d, "embeddings").filter("label < 5").withColumn("model", F.lit("m"))
    n = e.count()
    one = lambda rows, dim: library.index_valid(spark.createDataFrame([(rows, "m", dim)], "rows long, model string, dimension int"), e, "m")
    return one(250, 64).unionByName(one(n, 65)).unionByName(one(n, 64))


# ---- journals


@query("""WITH p AS (SELECT upper(p_brand) AS name, p_size AS year, p_retailprice AS jif, 'Q' || (p_partkey % 6) AS q, p_partkey FROM part), m AS (SELECT name, max(jif) AS jif, max(CASE WHEN q IN ('Q1', 'Q2', 'Q3', 'Q4') THEN q END) AS quartile FROM p WHERE year = (SELECT max(year) FROM p) GROUP BY name),
c AS (SELECT name, max(p_partkey % 4 + 1)::INTEGER AS partition, max(p_partkey % 2 = 0) AS top FROM p WHERE year = 40 AND year = (SELECT max(year) FROM p WHERE year <= 40) GROUP BY name),
x AS (SELECT name, max(p_partkey % 3)::INTEGER AS newer FROM p WHERE year = (SELECT max(year) FROM p WHERE year <= 30) GROUP BY name), w AS (SELECT DISTINCT upper(n_name) AS name, TRUE AS warning FROM nation), l AS (SELECT DISTINCT name, TRUE AS predatory FROM p WHERE p_partkey % 50 = 0)
SELECT name, jif, quartile, partition, top, newer, warning, predatory FROM m FULL JOIN c USING (name) FULL JOIN x USING (name) FULL JOIN w USING (name) FULL JOIN l USING (name)""")
def badge_map(spark, d):
    """What five tables say of each journal name."""
    p = t(spark, d, "part").select(F.col("p_brand").alias("journal_name"), F.col("p_size").alias("year"), F.col("p_retailprice").alias("jif"), F.concat(F.lit("Q"), F.col("p_partkey") % 6).alias("jif_quartile"), "p_partkey")
    parts = p.filter("year <= 40").select("journal_name", "year", (F.col("p_partkey") % 4 + 1).alias("major_quartile"), (F.col("p_partkey") % 2 == 0).alias("is_top"))
    newer = p.filter("year <= 30").select("journal_name", "year", (F.col("p_partkey") % 3).alias("major_quartile"))
    return library.badges(p, parts, newer, t(spark, d, "nation").select(F.col("n_name").alias("journal_name")), p.filter("p_partkey % 50 = 0"))


@query("""SELECT o_orderkey AS item_id, lower(o_orderpriority) AS value FROM orders WHERE o_orderkey % 13 > 0 AND lower(o_orderpriority) IN ('1-urgent', '5-low')""")
def items_by_attribute(spark, d):
    """Live items by a field's value, from an entity-attribute-value store."""
    o = t(spark, d, "orders")
    items = o.select(F.col("o_orderkey").alias("item_id"), (F.col("o_orderkey") % 13 == 0).alias("deleted"))
    fields = spark.createDataFrame([(1, "status"), (2, "DOI")], "field_id int, name string")
    values = o.select(F.concat(F.lit("https://doi.org/"), "o_orderpriority").alias("value")).distinct().withColumn("value_id", F.xxhash64("value")).unionByName(o.select(F.col("o_orderstatus").alias("value")).distinct().withColumn("value_id", F.xxhash64("value")))
    data = o.select(F.col("o_orderkey").alias("item_id"), F.lit(2).alias("field_id"), F.xxhash64(F.concat(F.lit("https://doi.org/"), "o_orderpriority")).alias("value_id")).unionByName(o.select(F.col("o_orderkey").alias("item_id"), F.lit(1).alias("field_id"), F.xxhash64("o_orderstatus").alias("value_id")))
    wanted = spark.createDataFrame([("doi:1-URGENT",), ("5-low",), (None,)], "value string")
    return library.items_by_field(items, fields, values, data, "DOI", wanted, N.doi)


@query("""WITH l AS (SELECT c_custkey AS ord, c_name AS name, c_mktsegment || c_nationkey AS issn FROM customer ORDER BY c_custkey LIMIT 10),
e AS (SELECT 100000 + s_suppkey AS ord, CASE WHEN s_suppkey % 4 = 0 THEN 'CUSTOMER#00000000' || (s_suppkey % 9) ELSE s_name END AS name, NULL AS issn FROM supplier), k AS (SELECT *, row_number() OVER (PARTITION BY upper(name) ORDER BY ord) AS n FROM e WHERE upper(name) NOT IN (SELECT upper(name) FROM l) QUALIFY n = 1)
SELECT ord, name, 0 AS place FROM l UNION ALL SELECT ord, name, 1 FROM k""")
def discover_merge(spark, d):
    """Local journals first, then external ones whose name and ISSN are new."""
    local = t(spark, d, "customer").select(F.col("c_custkey").alias("ord"), F.col("c_name").alias("name"), F.concat("c_mktsegment", "c_nationkey").alias("issn"))
    s = F.col("s_suppkey")
    ext = t(spark, d, "supplier").select((100_000 + s).alias("ord"), F.when(s % 4 == 0, F.concat(F.lit("customer#00000000"), s % 9)).otherwise(F.col("s_name")).alias("name"), F.lit(None).cast("string").alias("issn"))
    return library.discover(local, ext, "ord", lambda x: stored(spark, x)).select("ord", F.when(F.col("name").startswith("customer"), F.upper("name")).otherwise(F.col("name")).alias("name"), "place")


@query("SELECT p_partkey FROM part ORDER BY coalesce(CASE WHEN p_size > 25 THEN p_retailprice END, -1) DESC, p_partkey % 2, p_partkey LIMIT 60")
def discover_sort(spark, d):
    """Discovered journals by a number whose absence counts as -1."""
    rows = t(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.when(F.col("p_size") > 25, F.col("p_retailprice")).alias("jif"), (F.col("p_partkey") % 2).alias("place"))
    return rows.orderBy(*library.discover_order("jif")).limit(60).select(F.col("ord").alias("p_partkey"))


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS citing, l_partkey AS cited FROM lineitem), h AS (SELECT cited AS seed, citing AS id, row_number() OVER (PARTITION BY cited ORDER BY citing) AS n FROM e WHERE cited IN (SELECT p_partkey FROM part WHERE p_size = 7) QUALIFY n <= 5)
SELECT seed, id, o_orderpriority AS title FROM h JOIN orders ON o_orderkey = id""")
def cited_by(spark, d):
    """What cites each seed, one hop."""
    edges = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("citing"), F.col("l_partkey").alias("cited"))
    seeds = t(spark, d, "part").filter("p_size = 7").select(F.col("p_partkey").alias("id"))
    return library.cited(edges, seeds, "cited_by", t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title")), 5)


@query("SELECT s_suppkey AS id, s_suppkey % 3 = 0 OR s_suppkey % 5 = 0 AS in_library FROM supplier")
def mark_patents(spark, d):
    """Rows known by DOI or by patent number."""
    s = F.col("s_suppkey")
    rows = t(spark, d, "supplier").select(s.alias("id"), F.when(s % 3 == 0, F.concat(F.lit("https://doi.org/10.1/"), s)).alias("doi"), F.concat(F.lit("US "), 1_000_000 + s, F.lit(" B2")).alias("patent"))
    known = t(spark, d, "supplier").select(F.when(s % 3 == 0, F.concat(F.lit("10.1/"), s)).alias("doi"), F.when(s % 5 == 0, F.concat(F.lit("us-"), 1_000_000 + s, F.lit("-b2"))).alias("patent"))
    return library.mark_known(rows, known).select("id", "in_library")


# ---- discovery and scores


@query("""WITH x AS (SELECT doc_id, length(left(text, 60)) AS tl, length(text) AS n, doc_id * 31 % 100 AS ai FROM documents),
h AS (SELECT *, floor((CASE WHEN n < 50 THEN 5 WHEN n <= 300 THEN floor(n / 300 * 20 + 0.5) WHEN n <= 1000 THEN 30 ELSE 25 END) * 0.4::DOUBLE + (CASE WHEN tl = 0 THEN 0 WHEN tl BETWEEN 10 AND 200 THEN 20 WHEN tl BETWEEN 5 AND 300 THEN 10 ELSE 5 END) * 0.25::DOUBLE + 5 * 0.2::DOUBLE + least(10, log10(doc_id + 1.0) * 3) * 0.15::DOUBLE + 0.5)::BIGINT AS hs FROM x)
SELECT doc_id, floor(ai * 0.7::DOUBLE + hs * 0.3::DOUBLE + 0.5)::BIGINT AS score, greatest(hs, ai) AS best, CASE WHEN doc_id % 2 = 0 THEN 'review' ELSE 'research' END AS paper_type FROM h WHERE ai >= 40""")
def discovery_filter(spark, d):
    """Papers that a model scored high enough, with fused and best scores."""
    papers = t(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.left("text", F.lit(60)).alias("title"), F.col("text").alias("abstract"), F.lit("https://www.arxiv.org/abs/1").alias("url"), F.col("doc_id").alias("citations"))
    judged = t(spark, d, "documents").select(F.col("doc_id").alias("pos"), (F.col("doc_id") * 31 % 100).alias("ai_score"), F.when(F.col("doc_id") % 2 == 0, "review").alias("paper_type"), F.lit("r").alias("reason"))
    out = library.discovered(papers, judged.unionByName(judged.limit(1).withColumn("pos", F.lit(-1).cast("long"))))
    return out.select(F.col("pos").alias("doc_id"), "score", library.best_of(F.col("heuristic"), F.col("ai_score")).alias("best"), "paper_type")


@query("""SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN 'http://a.org/x' WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE 'HTTPS://b.org/pdf?f=.pdfx' END AS link, s_suppkey % 4 <> 3 AS specific FROM supplier""")
def link_and_query_gates(spark, d):
    """pages worth reading, and queries that are not rewritten."""
    s = F.col("s_suppkey")
    url = F.when(s % 5 == 0, "http://a.org/x").when(s % 5 == 1, "https://a.org/x.PDF?d=1").when(s % 5 == 2, "https://www.pubmed.ncbi.nlm.nih.gov/1").when(s % 5 == 3, "ftp://a.org").otherwise("HTTPS://b.org/pdf?f=.pdfx")
    asked = F.when(s % 4 == 0, "10.1234/x").when(s % 4 == 1, '"An exact title"').when(s % 4 == 2, " ab ").otherwise("graph neural networks")
    return t(spark, d, "supplier").select(s.alias("id"), library.page_link(url).alias("link"), library.is_specific(asked).alias("specific"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'Physik' WHEN s_suppkey % 3 = 1 THEN 'Physics' ELSE '-' END AS shown FROM supplier")
def language_choice(spark, d):
    """the primary language's name, else the other's, else a sign."""
    s = F.col("s_suppkey")
    return t(spark, d, "supplier").select(s.alias("id"), library.by_language("de", {"en": F.when(s % 3 < 2, "Physics"), "de": F.when(s % 3 == 0, "Physik").when(s % 3 == 1, " ")}, "-").alias("shown"))


@query("SELECT doc_id AS ord, left(text, 80) AS title, coalesce(lang, '') AS authors, source AS journal, '2000' AS year, n_chars::INTEGER AS citation_count, FALSE AS is_open_access, doc_id % 2 = 0 AS has_doi, 'https://doi.org/10.1/' || doc_id AS link FROM documents")
def article_shape(spark, d):
    """the wide row that a result list shows."""
    docs = t(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("ord"), F.left("text", F.lit(80)).alias("title"), F.coalesce("lang", F.lit("")).alias("authors"), F.col("source").alias("journal"), F.lit("2000").alias("year"), F.col("n_chars").cast("int").alias("citation_count"), F.lit(False).alias("is_open_access"), (F.col("doc_id") % 2 == 0).alias("has_doi"), F.concat(F.lit("https://doi.org/10.1/"), "doc_id").alias("link"))


@query("SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 40")
def next_page(spark, d):
    """The next rows of a list that is revealed step by step."""
    return library.reveal(t(spark, d, "documents"), [F.desc("n_chars"), F.asc("doc_id")], 40, 20).select("doc_id")


@query("SELECT p_partkey FROM part ORDER BY CASE WHEN contains(' ' || lower(p_name) || ' ', ' green ') THEN CASE WHEN starts_with(lower(p_name) || ' ', 'green ') THEN 2 ELSE 1 END ELSE 0 END DESC, lower(p_name), p_partkey LIMIT 40")
def title_order(spark, d):
    """A list by title, phrase hits first."""
    return t(spark, d, "part").orderBy(*ordering.display_order("title", "Green", "p_name", order="p_partkey")).limit(40).select("p_partkey")


# ---- what searches teach


_LEARNT = "SELECT user_id AS query, avg(value) AS mean_score, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY user_id"


@query(f"""WITH l AS ({_LEARNT}), v AS (SELECT CASE WHEN mean_score >= 60 AND n >= 3 THEN 'effective' WHEN mean_score < 30 THEN 'ineffective' END AS verdict, query, mean_score FROM l)
SELECT verdict, row_number() OVER (PARTITION BY verdict ORDER BY CASE WHEN verdict = 'effective' THEN -mean_score ELSE mean_score END, query) AS rank, query, round(mean_score, 4) AS mean_score FROM v WHERE verdict IS NOT NULL QUALIFY rank <= 20""")
def judged_queries(spark, d):
    """Effective and ineffective queries."""
    entries = t(spark, d, "events").filter("value is not null").groupBy(F.col("user_id").alias("query")).agg(F.avg("value").alias("mean_score"), F.count("*").alias("n"))
    return usage.judged_queries(entries).withColumn("mean_score", r("mean_score"))


@query("""WITH h AS (SELECT user_id % 40 AS q, event_type AS host, count(*) AS n, sum(value) AS s FROM events GROUP BY ALL), t AS (SELECT q, sum(s) / sum(n) AS m FROM h GROUP BY q), b AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY n DESC, host) AS k FROM h QUALIFY k <= 2)
SELECT host, count(*) AS n FROM b JOIN t USING (q) WHERE m >= 60 GROUP BY host HAVING avg(m) >= 60""")
def quality_hosts(spark, d):
    """Hosts of queries whose mean scores are high."""
    learnt = usage.learnt_queries(t(spark, d, "events").withColumn("q", F.col("user_id") % 40), "q", "value", "event_type", top=2)
    return usage.quality_hosts(learnt.select("mean_score", "hosts"))


@query("SELECT w AS concept, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS w FROM part) GROUP BY w ORDER BY n DESC, w LIMIT 15")
def top_concepts(spark, d):
    """The fifteen most frequent concepts."""
    return t(spark, d, "part").select(F.explode(F.split("p_type", " ")).alias("concept")).groupBy("concept").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "concept").limit(15)


@query("""WITH s AS (SELECT user_id, count(*) AS calls, round(sum(value), 4) AS value, arg_min(event_type, (ts, event_type)) AS model, max(ts) AS last_at FROM (SELECT * FROM events WHERE user_id IS NOT NULL) GROUP BY user_id)
SELECT user_id, value, model FROM s WHERE NOT ((SELECT count(*) FROM s) > 100 AND last_at < TIMESTAMP '2024-01-30 20:00:00' - INTERVAL 24 HOURS)""")
def session_usage(spark, d):
    """Usage of each session; of many, the idle ones go."""
    e = t(spark, d, "events").filter("user_id is not null")
    return usage.session_totals(e, "user_id", "ts", "event_type", ["value"], F.lit("2024-01-30 20:00:00").cast("timestamp")).select("user_id", r("value").alias("value"), "model")


@query("""WITH x AS (SELECT c_custkey AS ord, c_nationkey AS a, c_mktsegment AS b FROM customer), n AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY ord) AS i FROM x WHERE a >= 5)
SELECT ord, CASE WHEN a < 5 THEN 'ignored' WHEN (SELECT i FROM n WHERE n.ord = x.ord) = 1 THEN 'inserted' ELSE 'ignored' END AS status FROM x""")
def insert_under_keys(spark, d):
    """Inserts one after another under two unique keys, one of them null for new rows."""
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("ord"), F.col("c_nationkey").alias("a"), F.lit(None).cast("string").alias("b"))
    table = t(spark, d, "nation").filter("n_nationkey < 5").select(F.col("n_nationkey").alias("a"), F.lit("x").alias("b"))
    return mutation.insert_absent_any(table, c, [["a"], ["b"]], "ord", lambda x: stored(spark, x))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN 'untouched' WHEN c_custkey % 2 = 0 THEN 'noop' ELSE 'updated' END AS status, round(c_acctbal, 2) AS before, round(c_acctbal + CASE WHEN c_custkey % 6 = 3 THEN 1 ELSE 0 END, 2) AS after FROM customer""")
def update_rows(spark, d):
    """Updates of allowed columns with their images; a change of nothing is none."""
    c = t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    changes = c.filter("c_custkey % 3 = 0").select("c_custkey", F.lit("not allowed").alias("c_name"), (F.col("c_acctbal") + F.when(F.col("c_custkey") % 2 == 1, 1).otherwise(0)).alias("c_acctbal"))
    out = mutation.updates(c, changes, ["c_custkey"], ["c_acctbal"])
    return out.select("c_custkey", "status", r("before.c_acctbal", 2).alias("before"), r("after.c_acctbal", 2).alias("after"))


# ---- texts


@query("""SELECT doc_id, regexp_replace(left(text, 500), '(there|the)', '[\\1]', 'gi') AS marked FROM documents""")
def highlight_segments(spark, d):
    """Hits between marks."""
    return t(spark, d, "documents").select("doc_id", library.highlighted(F.left("text", F.lit(500)), ["the", "there"]).alias("marked"))


@query("""WITH x AS (SELECT page_id, replace(replace(replace(replace(replace(html || '&lt;p&gt; &amp;lt; &quot;' || url || '&quot; it&apos;s', '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&') AS t FROM pages)
SELECT page_id, md5(t) AS digest, length(t) AS n_chars FROM x""")
def xml_entities(spark, d):
    """Entities of whole pages, each decoded once."""
    raw = F.concat("html", F.lit("&lt;p&gt; &amp;lt; &quot;"), "url", F.lit("&quot; it&apos;s"))
    found = t(spark, d, "pages").select("page_id", library.xml_text(raw).alias("t"))
    return found.select("page_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n_chars"))


@query("""SELECT s_suppkey AS id, CASE s_suppkey % 6 WHEN 0 THEN 'intro' WHEN 1 THEN 'method' WHEN 2 THEN 'references' WHEN 3 THEN NULL WHEN 4 THEN 'conclusion' ELSE 'abstract' END AS section FROM supplier""")
def heading_sections(spark, d):
    """Section classes of heading lines."""
    s = F.col("s_suppkey")
    line = F.when(s % 6 == 0, "1.2 Introduction").when(s % 6 == 1, "III. Materials and Methods").when(s % 6 == 2, "References").when(s % 6 == 3, F.repeat(F.lit("Abstract words "), 9)).when(s % 6 == 4, "结论").otherwise("A. Abstract")
    return t(spark, d, "supplier").select(s.alias("id"), X.section(line).alias("section"))


_FOLD = r"([\p{L}\p{N}])[-_]([\p{L}\p{N}])"


@query(rf"""WITH x AS (SELECT doc_id, trim(replace(text, ' ', CASE doc_id % 3 WHEN 0 THEN '-' WHEN 1 THEN '_' ELSE ' - ' END), ' ') AS q FROM documents)
SELECT doc_id, md5(regexp_replace(regexp_replace(q, '{_FOLD}', '\1 \2', 'g'), '{_FOLD}', '\1 \2', 'g')) AS folded FROM x""")
def folded_queries(spark, d):
    """Hyphens and underscores between letters of whole texts as spaces."""
    joint = F.when(F.col("doc_id") % 3 == 0, "-").when(F.col("doc_id") % 3 == 1, "_").otherwise(" - ")
    asked = t(spark, d, "documents").select("doc_id", F.replace("text", F.lit(" "), joint).alias("q"))
    return asked.select("doc_id", F.md5(X.fold_query("q")).alias("folded"))


@query("SELECT doc_id, md5(text) AS abstract, len(string_split(text, ' ')) AS n_words FROM documents WHERE text IS NOT NULL")
def inverted_abstracts(spark, d):
    """Whole texts out of their inverted form, a map of word to positions."""
    index = t(spark, d, "documents").filter("text is not null").select("doc_id", X.inverted_text("text").alias("index"))
    n_words = F.aggregate(F.map_values("index"), F.lit(0).cast("long"), lambda n, places: n + F.size(places))
    return index.select("doc_id", F.md5(X.abstract_text("index")).alias("abstract"), n_words.alias("n_words"))


@query("""SELECT row_number() OVER (ORDER BY doc_id)::INTEGER AS n, '[' || row_number() OVER (ORDER BY doc_id) || '] ' || left(md5(text), 8) || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'Authors: ' || lang ELSE '' END || chr(10) || 'Journal: ' || source || chr(10) || 'Year: 2000' AS block FROM documents ORDER BY doc_id LIMIT 50""")
def citation_blocks(spark, d):
    """Numbered citation texts of a selection."""
    some = t(spark, d, "documents").orderBy("doc_id").limit(50)
    rows = some.select("doc_id", F.left(F.md5("text"), F.lit(8)).alias("title"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("authors"), F.col("source").alias("journal"), F.lit(2000).alias("year"), F.lit(" ").alias("doi"))
    return library.citation_list(rows, "doc_id")


@query("""WITH x AS (SELECT o_orderkey, CASE WHEN o_custkey > 100 THEN 30 WHEN o_custkey > 50 THEN 25 WHEN o_custkey > 20 THEN 20 WHEN o_custkey > 5 THEN 12 WHEN o_custkey > 0 THEN 6 ELSE 0 END AS c, CASE WHEN year(o_orderdate) = 2000 THEN 15 WHEN year(o_orderdate) = 1999 THEN 12 WHEN year(o_orderdate) >= 1998 THEN 8 ELSE 3 END AS y FROM orders)
SELECT o_orderkey, floor(0.33::DOUBLE * c + 0.33::DOUBLE * 24 + 0.17::DOUBLE * y + 0.5)::BIGINT AS part FROM x""")
def weighted_scores(spark, d):
    """Weighted total of citations, venue and recency."""
    total = C.half_up(0.33 * C.citation_band("o_custkey") + 0.33 * C.journal_tier(F.lit(False), F.lit("Q2"), F.lit(None).cast("int"), F.lit(None).cast("boolean")) + 0.17 * C.recency(F.year("o_orderdate"), 2000))
    return t(spark, d, "orders").select("o_orderkey", total.alias("part"))


# ---- domains


def _payloads(spark, d, source, fields):
    rows = t(spark, d, "supplier").select(F.lit(source).alias("source"), F.col("s_suppkey").alias("ord"), F.to_json(fields).alias("payload"))
    return rows


_S = F.col


@query("""SELECT 3 * s_suppkey + CASE s_suppkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS ord, CASE s_suppkey % 3 WHEN 0 THEN 'openalex' WHEN 1 THEN 'crossref' ELSE 'serper' END AS source, s_name AS title, CASE WHEN s_suppkey % 3 < 2 THEN 'A; B' END AS authors,
CASE WHEN s_suppkey % 3 = 2 THEN '2009' ELSE '2020' END AS year, CASE WHEN s_suppkey % 3 = 2 THEN 'web:http://x/' || s_suppkey ELSE '10.1/' || s_suppkey END AS dedup_key, CASE WHEN s_suppkey % 3 < 2 THEN s_suppkey::VARCHAR END AS citations FROM supplier""")
def service_payloads(spark, d):
    """Rows of three services' own payloads under one schema."""
    s = _S("s_suppkey")
    doi = F.concat(F.lit("10.1/"), s)
    who = F.array(F.lit("A"), F.lit("B"))
    openalex = F.struct(F.concat(F.lit("https://openalex.org/W"), s).alias("id"), F.col("s_name").alias("display_name"), F.transform(who, lambda x: F.struct(F.struct(x.alias("display_name")).alias("author"))).alias("authorships"), F.lit(2020).alias("publication_year"), F.concat(F.lit("https://doi.org/"), doi).alias("doi"), s.alias("cited_by_count"))
    crossref = F.struct(doi.alias("DOI"), F.array("s_name").alias("title"), F.transform(who, lambda x: F.struct(x.alias("family"))).alias("author"), F.struct(F.array(F.array(F.lit(2020), F.lit(5))).alias("date-parts")).alias("issued"), s.alias("is-referenced-by-count"))
    serper = F.struct(F.concat(F.lit("http://x/"), s).alias("link"), F.col("s_name").alias("title"), F.lit("Jan 2009").alias("date"))
    used = {"openalex": openalex, "crossref": crossref, "serper": serper}
    parts = [_payloads(spark, d, name, fields).filter(f"ord % 3 = {k}") for k, (name, fields) in enumerate(used.items())]
    rows = recorded.result_rows(parts[0].unionByName(parts[1]).unionByName(parts[2]), list(used))
    rank = F.when(F.col("source") == "openalex", 0).when(F.col("source") == "crossref", 1).otherwise(2)
    return rows.select((3 * F.col("ord") + rank).alias("ord"), "source", "title", "authors", "year", "dedup_key", F.try_element_at("metrics", F.lit("citations")).alias("citations"))


@query("""SELECT s_suppkey AS ord, 'figshare:' || s_suppkey AS dedup_key, CASE WHEN s_suppkey % 2 = 0 THEN 'CC BY 4.0' ELSE 'cc-by' END AS license, 'a; b' AS creators FROM supplier WHERE s_suppkey % 4 IN (0, 1)""")
def domain_license(spark, d):
    """Data sets of one licence, read from the payloads' own fields, as saved."""
    s = _S("s_suppkey")
    lic = F.when(s % 4 == 0, "CC BY 4.0").when(s % 4 == 1, "cc-by").when(s % 4 == 2, "CC0").otherwise("CC-BY-NC 4.0")
    p = _payloads(spark, d, "figshare", F.struct(s.cast("string").alias("id"), F.lit("t").alias("title"), lic.alias("license"), F.array(F.lit("a"), F.lit("b")).alias("creators")))
    rows, _ = domains.search(spark, p, "dataset", 10**6, {"license": "CC-BY"}, chosen=["figshare"])
    return rows.select("ord", "dedup_key", F.col("extra")["License"].alias("license"), F.col("extra")["Creators"].alias("creators"))


@query("SELECT s_suppkey AS ord FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 2 = 0")
def domain_tags(spark, d):
    """data sets by open-access type, and by any tag."""
    s = _S("s_suppkey")
    p = _payloads(spark, d, "dryad", F.struct(s.cast("string").alias("id"), F.lit("t").alias("title"), F.when(s % 3 == 0, "GOLD").otherwise("closed").alias("oaType")))
    q = _payloads(spark, d, "uci", F.struct(s.cast("string").alias("id"), F.lit("t").alias("title"), F.array(F.lit("x"), F.when(s % 2 == 0, "Image-Text").otherwise("audio")).alias("taskTags")))
    gold, _ = domains.search(spark, p, "dataset", 10**6, {"oaType": "gold"}, chosen=["dryad"])
    tagged, _ = domains.search(spark, q, "dataset", 10**6, {"taskTags": ["image"]}, chosen=["uci"])
    return gold.select("ord").join(tagged.select("ord"), "ord")


@query("SELECT s_suppkey AS ord FROM supplier WHERE s_suppkey % 3 = 1")
def domain_country(spark, d):
    """data sets whose coverage names a country."""
    s = _S("s_suppkey")
    p = _payloads(spark, d, "icpsr", F.struct(s.cast("string").alias("id"), F.lit("t").alias("title"), F.when(s % 3 == 1, "Europe, FRANCE").otherwise("Chile").alias("geographicCoverage")))
    return domains.search(spark, p, "social-science", 10**6, {"country": "France"}, chosen=["icpsr"])[0].select("ord")


@query("""SELECT s_suppkey AS ord, CASE s_suppkey % 6 WHEN 0 THEN 'granted' WHEN 1 THEN 'published' WHEN 2 THEN 'utility' WHEN 3 THEN 'provisional' WHEN 4 THEN 'unknown' END AS status, CASE WHEN s_suppkey % 2 = 0 THEN '2' END AS family, (s_suppkey % 9)::VARCHAR AS citations FROM supplier""")
def domain_patent(spark, d):
    """Legal status by kind code, citations and family size."""
    s = _S("s_suppkey")
    kind = F.element_at(F.array(*map(F.lit, ("B2", "A1", "U1", "P1", "C1", ""))), (s % 6 + 1).cast("int"))
    p = _payloads(spark, d, "uspto", F.struct(F.concat(F.lit("US"), 1_000_000 + s, kind).alias("id"), F.lit("t").alias("title"), (s % 9).alias("citationCount"), F.when(s % 2 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array().cast("array<string>")).alias("familyMembers")))
    rows, _ = domains.search(spark, p, "patent", 10**6, chosen=["uspto"])
    return rows.select("ord", "status", F.col("metrics")["familySize"].alias("family"), F.col("metrics")["citations"].alias("citations"))


@query("""SELECT s_suppkey AS ord, CASE s_suppkey % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'active' WHEN 2 THEN 'terminated' END AS status, CASE WHEN s_suppkey % 3 > 0 THEN '$1,' || lpad((s_suppkey % 1000)::VARCHAR, 3, '0') END AS amount, CASE WHEN s_suppkey % 2 = 0 THEN '2020 ~ 2022' END AS term FROM supplier""")
def domain_grant(spark, d):
    """Amount, period and status class; "inactive" is not active."""
    s = _S("s_suppkey")
    p = _payloads(spark, d, "nih", F.struct(s.cast("string").alias("id"), F.lit("t").alias("title"), F.when(s % 4 == 0, "Inactive").when(s % 4 == 1, "In progress").when(s % 4 == 2, "Cancelled").alias("status"), F.when(s % 3 > 0, 1000 + s % 1000).otherwise(0).alias("amount"), F.lit("2020").alias("startDate"), F.when(s % 2 == 0, "2022").alias("endDate")))
    return domains.search(spark, p, "grant", 10**6, chosen=["nih"])[0].select("ord", "status", "amount", "term")


@query("""SELECT s_suppkey AS ord, CASE s_suppkey % 5 WHEN 0 THEN 'recruiting' WHEN 1 THEN 'completed' WHEN 2 THEN 'terminated' WHEN 3 THEN 'withdrawn' ELSE 'unknown' END AS status, CASE WHEN s_suppkey % 2 = 0 THEN 'PHASE1/PHASE2' END AS phase FROM supplier""")
def domain_trial(spark, d):
    """Phases and status classes of trials."""
    s = _S("s_suppkey")
    said = F.element_at(F.array(*map(F.lit, ("NOT_YET_RECRUITING", "Completed", "TERMINATED", "Withdrawn", "Approved"))), (s % 5 + 1).cast("int"))
    p = _payloads(spark, d, "clinicaltrials", F.struct(s.cast("string").alias("id"), F.lit("t").alias("title"), said.alias("status"), F.when(s % 2 == 0, F.array(F.lit("PHASE1"), F.lit("PHASE2"))).alias("phases")))
    return domains.search(spark, p, "clinicaltrial", 10**6)[0].select("ord", "status", "phase")


@query("""SELECT s_suppkey AS ord, CASE WHEN s_suppkey > 100 THEN 'prolific' WHEN s_suppkey > 20 THEN 'active' WHEN s_suppkey > 0 THEN 'emerging' END AS status, 'MIT' || CASE WHEN s_suppkey % 2 = 0 THEN ' (US)' ELSE '' END AS place FROM supplier""")
def domain_researcher(spark, d):
    """Activity level and place of researchers."""
    s = _S("s_suppkey")
    p = _payloads(spark, d, "openalex-author", F.struct(s.cast("string").alias("id"), F.lit("n").alias("display_name"), s.alias("works_count"), F.struct(F.lit("MIT").alias("display_name"), F.when(s % 2 == 0, "US").alias("country_code")).alias("institution")))
    return domains.search(spark, p, "researcher", 10**6, chosen=["openalex-author"])[0].select("ord", "status", "place")


@query("SELECT s_suppkey AS ord, CASE s_suppkey % 2 WHEN 0 THEN 'Physics Literature' ELSE 'preprint' END AS kind, CASE WHEN s_suppkey % 2 = 1 THEN FALSE END AS peer_reviewed FROM supplier")
def domain_labels(spark, d):
    """What sources' items are called, and what preprints are."""
    s = _S("s_suppkey")
    fields = F.struct(s.cast("string").alias("id"), F.lit("t").alias("title"))
    physics, _ = domains.search(spark, _payloads(spark, d, "inspire", fields).filter("ord % 2 = 0"), "physics", 10**6, chosen=["inspire"])
    prints, _ = domains.search(spark, _payloads(spark, d, "chemrxiv", fields).filter("ord % 2 = 1"), "preprint", 10**6, chosen=["chemrxiv"])
    return physics.select("ord", F.col("data_type").alias("kind"), F.lit(None).cast("boolean").alias("peer_reviewed")).unionByName(prints.select("ord", F.col("document_type").alias("kind"), "peer_reviewed"))


@query("""SELECT s_suppkey AS ord, CASE WHEN s_suppkey % 3 = 0 THEN 'P' END AS publisher, CASE WHEN s_suppkey % 3 = 0 THEN 'cc-by-4.0' ELSE 'own' END AS license FROM supplier""")
def registry_overlay(spark, d):
    """Publisher, creators and licence of a recorded DOI registry over the payloads'."""
    s = _S("s_suppkey")
    p = _payloads(spark, d, "dryad", F.struct(s.cast("string").alias("id"), F.lit("t").alias("title"), F.concat(F.lit("10.5/"), s).alias("doi"), F.lit("own").alias("license")))
    rows, _ = domains.search(spark, p, "dataset", 10**6, chosen=["dryad"])
    known = t(spark, d, "supplier").filter("s_suppkey % 3 = 0").select(F.concat(F.lit("https://doi.org/10.5/"), s).alias("doi"), F.lit("P").alias("publisher"), F.array().cast("array<string>").alias("creators"), F.array(F.lit("other"), F.lit("cc-by-4.0")).alias("licenses"))
    m = F.col("metrics")
    return domains.overlay_registry(rows, known).select("ord", F.try_element_at(m, F.lit("publisher")).alias("publisher"), m["license"].alias("license"))


@query("SELECT p_partkey, s_name AS name, CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 1 END AS step FROM part JOIN supplier ON s_suppkey = 1 + p_partkey % (SELECT count(*) FROM supplier)")
def metrics_by_issn(spark, d):
    """Journal metrics by ISSN, else by name."""
    n = t(spark, d, "supplier").count()
    dim = t(spark, d, "supplier").select("s_name", "s_suppkey", F.lpad(F.col("s_suppkey").cast("string"), 8, "0").alias("issn"))
    k = (1 + F.col("p_partkey") % n).cast("string")
    asked = t(spark, d, "part").join(dim.select(F.col("s_suppkey").alias("_k"), F.col("s_name").alias("_n")), (1 + F.col("p_partkey") % n) == F.col("_k"))
    issn = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.left(F.lpad(k, 8, "0"), F.lit(4)), F.lit("-"), F.right(F.lpad(k, 8, "0"), F.lit(4))))
    ladder = [(N.issn(issn), dim, [N.issn("issn")], "s_suppkey"), (N.journal_name(F.lower("_n")), dim, [N.journal_name("s_name")], "s_suppkey")]
    return joins.cascade(asked, ladder, "hit").select("p_partkey", F.col("hit.s_name").alias("name"), F.col("hit_step").alias("step"))


@query("""SELECT user_id, max(ts) AS last_at, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY user_id ORDER BY last_at DESC, user_id LIMIT 20""")
def recent_searches(spark, d):
    """The twenty latest searches, each once."""
    e = t(spark, d, "events").filter("user_id is not null")
    return e.groupBy("user_id").agg(F.max("ts").alias("last_at"), F.count("*").alias("n")).orderBy(F.desc("last_at"), "user_id").limit(20)


_HASHED = """WITH k AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents), c AS (SELECT doc_id, ('0x' || left(md5(w), 8))::BIGINT AS h FROM k),
b AS (SELECT doc_id, (h % 16)::INTEGER AS b, sum(CASE WHEN h >= 2147483648 THEN -1 ELSE 1 END)::DOUBLE AS x FROM c GROUP BY ALL), a AS (SELECT doc_id, i::INTEGER AS dim FROM documents, generate_series(0, 15) g(i))
SELECT a.doc_id, a.dim, coalesce(x, 0) AS x FROM a LEFT JOIN b ON a.doc_id = b.doc_id AND a.dim = b.b"""


@query(_HASHED)
def hashed_embeddings(spark, d):
    """Vectors of a provider that needs no model."""
    texts = t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return index.Hashing(dims=16).embed(texts).select(F.col("id").alias("doc_id"), F.posexplode("embedding").alias("dim", "x"))


@query(f"""WITH v AS ({_VEC}), n AS (SELECT vec_id, v FROM v WHERE vec_id % 3 > 0 AND vec_id % 7 > 0 UNION ALL SELECT vec_id, (SELECT v FROM v WHERE vec_id = 0) FROM v WHERE vec_id % 7 = 0 AND vec_id BETWEEN 7 AND 30)
SELECT vec_id AS id, round({_COS}, 6) AS similarity FROM n, (SELECT v AS q FROM v WHERE vec_id = 0) ORDER BY {_COS} DESC, vec_id LIMIT 10""")
def index_changes(spark, d):
    """An index after removals and additions."""
    e = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    q = vector_of(spark, d)
    new = e.filter("id % 7 = 0 and id between 7 and 30").withColumn("embedding", F.array(*map(F.lit, q)).cast("array<double>"))
    now = index.Index(e).remove(e.filter("id % 3 = 0 or id % 7 = 0").select("id")).add(new).add(new)
    return now.search(q, 10).select("id", r("similarity", 6).alias("similarity"))


@query("""SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'PCR cancer' WHEN 1 THEN 'study' ELSE '图 学习' END AS openalex, CASE s_suppkey % 3 WHEN 0 THEN 'cancer' WHEN 1 THEN 'the study of' ELSE '图 学习' END AS arxiv,
CASE s_suppkey % 3 WHEN 0 THEN '("Polymerase Chain Reaction"[MeSH Terms]) AND "PCR"[Title/Abstract] AND ("Neoplasms"[MeSH Terms] OR "Cancer"[MeSH Terms]) AND "cancer"[Title/Abstract]' WHEN 1 THEN '"study"[All Fields]' ELSE '图 学习' END AS pubmed FROM supplier""")
def adapted_queries(spark, d):
    """X11: one query in the form that each engine takes, with subject headings."""
    s = F.col("s_suppkey")
    asked = t(spark, d, "supplier").select(s.alias("id"), F.when(s % 3 == 0, "the PCR of cancer").when(s % 3 == 1, "the study of").otherwise("图 学习").alias("query"))
    mesh = spark.createDataFrame([("pcr", ["Polymerase Chain Reaction"]), ("cancer", ["Neoplasms", "Cancer"])], "term string, names array<string>")
    return dialects.adapted(asked, mesh, ["the", "and"], ["pcr", "study"]).select("id", "openalex", "arxiv", "pubmed")


@query("""WITH x AS (SELECT * FROM documents WHERE doc_id % 10 = 0), o AS (SELECT *, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS n FROM x)
SELECT 0 AS n, chr(65279) || 'Title,Authors,Year,Journal,DOI,Citations,Source,PDF URL' AS line UNION ALL
SELECT n::INTEGER, '"say ' || repeat(chr(34), 2) || left(md5(text), 6) || repeat(chr(34), 3) || ',"a, b",2000,' || coalesce(lang, '') || ',,' || n_chars || ',' || coalesce(source, '') || ',' FROM o""")
def result_csv(spark, d):
    """Chosen rows as CSV lines in display order, with header and byte order mark."""
    docs = t(spark, d, "documents").select("doc_id", "n_chars", F.concat(F.lit('say "'), F.left(F.md5("text"), F.lit(6)), F.lit('"')).alias("title"), F.lit("a, b").alias("authors"), F.lit("2000").alias("year"), F.col("lang").alias("journal"), F.lit(None).cast("string").alias("doi"), F.col("n_chars").alias("citations"), "source", F.lit("").alias("pdf_url"))
    return datasets.result_lines(docs, [F.desc("n_chars"), F.asc("doc_id")], F.col("doc_id") % 10 == 0)


@query("""SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 's'), '\\s+', ' ', 'g')) AS title, 'about ' || page_id AS description FROM pages""")
def page_metadata(spark, d):
    """Title and description of pages."""
    html = F.replace("html", F.lit("<head>"), F.concat(F.lit("<head><meta content='about "), F.col("page_id").cast("string"), F.lit("' name=description />")))
    found = markup.page_metadata(html)
    return t(spark, d, "pages").select("page_id", found["title"].alias("title"), found["description"].alias("description"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 100.0 WHEN doc_id % 4 = 1 THEN 0.0 WHEN doc_id % 4 = 2 THEN 62.5 ELSE 0.0 END::DOUBLE AS score, CASE WHEN doc_id % 4 = 2 THEN 'review' ELSE '' END AS paper_type, doc_id % 4 = 3 AS ai_failed FROM documents""")
def parsed_evaluations(spark, d):
    """A model's verdicts with clamped fields, defaults where it gave none."""
    k = F.col("doc_id") % 4
    verdict = F.when(k == 0, '{"i": 0, "score": 170}').when(k == 1, '{"i": 0, "score": "much"}').when(k == 2, '{"i": "x"}, {"i": 0, "score": 62.5, "paper_type": "review"}')
    answer = F.concat(F.lit('Here:\n```json\n{"evaluations": ['), verdict, F.lit("]}\n```"))
    docs = t(spark, d, "documents")
    answers = docs.select(F.col("doc_id").alias("batch"), F.coalesce(answer, F.lit("no { json")).alias("answer"))
    return C.judged(docs.select("doc_id", F.col("doc_id").alias("batch"), F.lit(0).alias("pos")), answers).select("doc_id", "score", "paper_type", "ai_failed")


@query("""SELECT s_suppkey AS id, CASE s_suppkey % 2 WHEN 0 THEN 'DOI: 10.1/' || s_suppkey || chr(10) || 'Note: kept' ELSE 'DOI: 10.1/' || s_suppkey END AS extra FROM supplier""")
def extra_lines(spark, d):
    """Keyed lines of an item's extra field, replaced or added."""
    s = _S("s_suppkey")
    old = F.when(s % 2 == 0, "doi: old\nNote: kept\nPMID: 1")
    new = datasets.upsert_lines(old, {"DOI": F.concat(F.lit("10.1/"), s), "PMID": F.lit(None).cast("string")})
    return t(spark, d, "supplier").select(s.alias("id"), new.alias("extra"))


@query("""WITH l AS (SELECT upper(p_brand) AS k, arg_max(p_type, (p_partkey, p_type)) AS c FROM part WHERE p_partkey % 5 = 0 GROUP BY 1) SELECT p_partkey, c AS risk FROM part LEFT JOIN l ON k = upper(p_brand)""")
def risk_exact(spark, d):
    """Category of exactly listed names, of a name's rows the last."""
    part = t(spark, d, "part")
    listed = part.filter("p_partkey % 5 = 0").select(F.col("p_brand").alias("name"), F.col("p_type").alias("category"), F.col("p_partkey").alias("ord"))
    return risk.exact_batch(part.withColumn("journal", F.lower("p_brand")), listed).select("p_partkey", "risk")


@query("""SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'pku,cscd' WHEN 1 THEN 'cssci' ELSE '' END AS lists FROM supplier""")
def core_list_tags(spark, d):
    """J19d: codes of the core lists that name a journal."""
    s = _S("s_suppkey")
    ranks = F.create_map(F.lit("北大核心2023"), F.when(s % 3 == 0, "1").otherwise("-"), F.lit("CSCD"), F.when(s % 3 == 0, "core").otherwise(""), F.lit("CSSCI"), F.when(s % 3 == 1, "2").otherwise("-"))
    return t(spark, d, "supplier").select(s.alias("id"), F.array_join(C.core_lists(ranks), ",").alias("lists"))


@query("""WITH f AS (SELECT doc_id AS id, text AS content, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (doc_id % 50) AS seen, CASE WHEN doc_id % 2 = 0 THEN TIMESTAMP '2024-01-02' END AS ends FROM documents WHERE doc_id % 5 > 0),
h AS (SELECT *, CASE WHEN contains(lower(content), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(content), 'trash') THEN 1 ELSE 0 END AS hits FROM f WHERE ends IS NULL)
SELECT id, hits FROM h WHERE hits > 0 ORDER BY hits DESC, seen DESC, id LIMIT 20""")
def recalled_facts(spark, d):
    """Live facts by the words they hold; expired and forgotten ones are out."""
    at = F.timestamp_add("HOUR", F.col("doc_id") % 50, F.lit("2024-01-01").cast("timestamp"))
    facts = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), at.alias("updated_at"), F.when(F.col("doc_id") % 2 == 0, F.lit("2024-01-02").cast("timestamp")).alias("expires_at"))
    left = memory.forget(facts, facts.filter("id % 5 = 0"))
    return memory.recall(left, F.lit("2024-02-01").cast("timestamp"), ["The", "trash"]).select("id", "hits")


@query("""SELECT s_suppkey AS id, n::INTEGER AS chunk_index, CASE n WHEN 0 THEN 'abstract' WHEN 1 THEN 'method' ELSE 'references' END AS category, CASE n WHEN 0 THEN 'We show ' || s_name || '.' WHEN 1 THEN 'Step one.' || chr(10) || 'Step two.' ELSE 'One 2020' END AS chunk_text FROM supplier, generate_series(0, 2) g(n)""")
def article_chunks(spark, d):
    """Sections of XML articles, packed by paragraph; those that bear methods."""
    xml = F.concat(F.lit("<article><front><abstract><p>We show "), F.col("s_name"), F.lit(".</p></abstract></front><body><sec><title>2. Methods</title><p>Step <i>one</i>.</p><p>Step two.</p></sec></body><back><ref-list><ref>One 2020</ref></ref-list></back></article>"))
    chunks = markup.xml_chunks(t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), xml.alias("xml")))
    return chunks.join(markup.bears_methods(chunks, "id"), "id", "left_semi").select("id", "chunk_index", "category", "chunk_text")


@query("""SELECT 'http://a/' || s_suppkey AS url, s_name || ' & co' AS title, 'Li, Ou' AS authors, 2021 AS year, '10.1/' || s_suppkey AS doi FROM supplier""")
def feed_entries(spark, d):
    """Records of Atom feeds."""
    s = _S("s_suppkey")
    feed = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom" xmlns:a="http://x"><entry><id>http://a/'), s, F.lit("</id><title>"), F.col("s_name"), F.lit("\n &amp; co</title><author><name>Li</name></author><author><name>Ou</name></author><published>2021-02-03</published><a:doi>10.1/"), s, F.lit("</a:doi></entry><entry><id>x</id></entry></feed>"))
    return markup.atom_records(t(spark, d, "supplier").select(feed.alias("xml"))).select("url", "title", "authors", "year", "doi")


@query("""SELECT doc_id AS ord FROM documents WHERE doc_id % 3 = 0""")
def open_access_only(spark, d):
    """articles that any source calls open."""
    docs = t(spark, d, "documents")
    rows = docs.select(F.col("doc_id").alias("ord"), F.concat(F.lit("10.1/"), "doc_id").alias("doi"), F.lit("t").alias("title"), F.lit("a").alias("abstract"), F.lit("x").alias("authors"), F.lit("j").alias("journal"), F.lit(2000).alias("year"), F.lit(0).alias("citations"), (F.col("doc_id") % 3 == 0).alias("is_open_access"), F.lit(None).cast("string").alias("url"), "source")
    both = rows.unionByName(rows.withColumn("ord", F.col("ord") + 10**9).withColumn("is_open_access", F.lit(False)))
    return literature.merge(both).filter("is_open_access").select("ord")


@query(_HASHED)
def index_refresh(spark, d):
    """An index brought up to date: fresh vectors stay, stale and new texts are embedded, orphans go."""
    now = t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    k = F.col("id")
    old = now.filter(k % 3 > 0).withColumn("text", F.when(k % 5 == 0, "old text").otherwise(F.col("text"))).unionByName(now.limit(1).withColumn("id", F.lit(-1).cast("long")))
    maker = index.Hashing(dims=16)
    done = index.refresh(index.Index(maker.embed(old)), old, now, maker)
    return done.vectors.select(F.col("id").alias("doc_id"), F.posexplode("embedding").alias("dim", "x"))


# ---- titles and queries that are alike

_LETTERS = "regexp_replace(lower(title), '[^a-z0-9一-鿿]+', '', 'g')"
_KNOWN = rf"""line AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, 2000 + doc_id % 7 AS year FROM documents),
known AS (SELECT doc_id AS ord, '10.1/' || doc_id AS doi, year, {_LETTERS} AS l FROM line WHERE doc_id % 4 > 0),
asked AS (SELECT doc_id AS id, 2000 + doc_id % 5 AS year, regexp_replace(lower(regexp_replace(title, '^\S+\s+', '')), '[^a-z0-9一-鿿]+', '', 'g') AS l FROM line SEMI JOIN labels USING (doc_id)),
kg AS (SELECT *, CASE WHEN length(l) > 1 THEN list_distinct([substr(l, i, 2) for i in range(1, length(l))]) ELSE [] END AS g FROM known), ag AS (SELECT *, CASE WHEN length(l) > 1 THEN list_distinct([substr(l, i, 2) for i in range(1, length(l))]) ELSE [] END AS g FROM asked),
sims AS (SELECT a.id, k.ord, k.doi, a.year = k.year AS hit, CASE WHEN a.l = k.l AND a.l <> '' THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(a.g, k.g)) / nullif(len(a.g) + len(k.g), 0) END AS sim FROM ag a JOIN kg k ON (len(k.g) >= 0.53 * len(a.g) AND len(a.g) >= 0.53 * len(k.g)) OR a.l = k.l),
best AS (SELECT * FROM sims WHERE sim >= 0.7 QUALIFY row_number() OVER (PARTITION BY id ORDER BY hit DESC, CASE WHEN hit THEN 0 ELSE -sim END, ord) = 1)"""


def _titles(spark, d):
    line = t(spark, d, "documents").select("doc_id", F.element_at(F.split("text", "\n", 2), 1).alias("title"), (2000 + F.col("doc_id") % 7).alias("year"))
    known = line.filter("doc_id % 4 > 0").select(F.col("doc_id").alias("ord"), "title", F.concat(F.lit("10.1/"), "doc_id").alias("doi"), "year")
    asked = line.join(t(spark, d, "labels"), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.regexp_replace("title", r"^\S+\s+", "").alias("title"), (2000 + F.col("doc_id") % 5).alias("year"))
    return setjoin.resolve_titles(asked, known, X.bigrams, N.title_letters, lambda x: stored(spark, x))


@query(f"WITH {_KNOWN} SELECT a.id, b.doi, round(b.sim, 6) AS similarity FROM asked a LEFT JOIN best b USING (id)")
def resolved_titles(spark, d):
    """First lines without their first word, resolved to the DOI of the best known title."""
    return _titles(spark, d).select("id", "doi", r("similarity", 6).alias("similarity"))


@query(f"""WITH {_KNOWN}, x AS (SELECT a.id, b.doi FROM asked a LEFT JOIN best b USING (id)), lib AS (SELECT DISTINCT '10.1/' || item_id AS doi FROM benchmark)
SELECT id, doi, CASE WHEN doi IS NULL THEN 'unresolved' WHEN doi IN (SELECT doi FROM lib) THEN 'exists' WHEN row_number() OVER (PARTITION BY doi ORDER BY id) > 1 THEN 'duplicate' ELSE 'added' END AS status FROM x""")
def title_receipts(spark, d):
    """Receipts of an import of titles, each resolved first."""
    library_dois = t(spark, d, "benchmark").select(F.concat(F.lit("10.1/"), "item_id").alias("doi"))
    return mutation.receipts(_titles(spark, d), library_dois, "doi", "id").select("id", "doi", "status")


@query("""WITH q AS (SELECT lower(trim(x)) AS k, arg_min(trim(x), ord) AS query, min(ord) AS ord FROM (SELECT doc_id AS ord, split_part(text, chr(10), 1) AS x FROM documents) WHERE trim(x) <> '' GROUP BY 1),
s AS (SELECT ord, query, list_distinct(list_concat([w for w in regexp_extract_all(lower(query), '[a-z]{3,}|[0-9]+')], CASE WHEN len(regexp_extract_all(query, '[一-鿿]')) > 1 THEN [regexp_extract_all(query, '[一-鿿]')[i] || regexp_extract_all(query, '[一-鿿]')[i + 1] for i in range(1, len(regexp_extract_all(query, '[一-鿿]')))] ELSE [] END)) AS g FROM q),
p AS (SELECT a.ord AS a, b.ord AS b FROM s a JOIN s b ON a.ord <> b.ord AND len(a.g) > 0 AND len(b.g) > 0 AND 2 * len(a.g) > len(b.g) AND 2 * len(b.g) > len(a.g) AND 3 * len(list_intersect(a.g, b.g)) > len(a.g) + len(b.g)),
c AS (WITH RECURSIVE w AS (SELECT ord, ord AS here FROM s UNION SELECT w.ord, p.b FROM w JOIN p ON p.a = w.here) SELECT ord, min(here) AS cluster FROM w GROUP BY ord)
SELECT cluster, arg_max(query, (length(query) >= 10 AND len(regexp_extract_all(query, '[a-zA-Z]+')) + len(regexp_extract_all(query, '[一-鿿]')) >= 2, length(query), ord)) AS query, count(*) AS size FROM s JOIN c USING (ord) GROUP BY cluster""")
def query_clusters(spark, d):
    """First lines as queries, one for each chain of alike ones."""
    lines = t(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.element_at(F.split("text", "\n", 2), 1).alias("query"))
    return setjoin.query_clusters(lines, lambda x: stored(spark, x))


NAMES = [n for n in QUERIES if n not in _before]
