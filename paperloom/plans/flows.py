"""Registered end-to-end plans and streams on the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import risk
from ..sources import payloads
from ..sources.shared import shared_dir
from ..streaming import feeds
from . import domains, literature
from .registry import query, r, t


def _scratch(spark) -> str:
    return f"{shared_dir(spark)}/paperloom/{uuid.uuid4().hex}"


@query("""WITH a AS (SELECT d.doc_id AS ord, CASE WHEN d.doc_id % 5 > 0 THEN '10.1/' || left(md5(text), 12) END AS doi, left(text, 80) AS title, d.n_chars AS citations, d.source FROM documents d),
m AS (SELECT min(ord) AS ord, arg_max(title, (length(title), -ord)) AS title, max(citations) AS citations, array_to_string(list_distinct(list(source)), ',') AS s, count(*) AS n_merged, min(doi) AS doi FROM a GROUP BY coalesce(doi, ord::VARCHAR))
SELECT ord, title, citations, n_merged, doi IN (SELECT '10.1/' || left(md5(text), 12) FROM documents SEMI JOIN labels USING (doc_id)) AND doi IS NOT NULL AS in_library FROM m ORDER BY ord LIMIT 200""")
def literature_search(spark, d):
    """3.1: union, merge, enrich, cap and mark."""
    docs = t(spark, d, "documents")
    doi = F.concat(F.lit("10.1/"), F.left(F.md5("text"), F.lit(12)))
    batch = docs.select(F.col("doc_id").alias("ord"), F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("https://doi.org/"), doi)).alias("doi"), F.left("text", F.lit(80)).alias("title"), F.col("text").alias("abstract"), F.col("lang").alias("authors"), F.col("source").alias("journal"), F.lit(2000).alias("year"), F.col("n_chars").alias("citations"), F.lit(True).alias("is_open_access"), F.lit(None).cast("string").alias("url"), "source")
    metrics = t(spark, d, "part").select(F.col("p_size").alias("year"), F.col("p_brand").alias("journal_name"), F.col("p_retailprice").alias("jif"), F.lit("Q1").alias("jif_quartile"))
    library = docs.join(t(spark, d, "labels"), "doc_id", "left_semi").select(doi.alias("doi"))
    found = literature.search(batch, metrics, t(spark, d, "region").select(F.col("r_name").alias("journal_name")), library, 200)
    return found.select("ord", "title", "citations", "n_merged", "in_library")


@query("""WITH j AS (SELECT p_partkey AS k, lpad(p_partkey::VARCHAR, 7, '0') || 'X' AS issn, 'E' || lpad(p_partkey::VARCHAR, 7, '0') AS eissn, p_size AS year, p_retailprice AS jif, 'Q' || (p_partkey % 6) AS q, p_name, p_brand FROM part),
n AS (SELECT count(*) AS n FROM part), a AS (SELECT doc_id, doc_id % (SELECT n FROM n) AS k, doc_id % 3 AS kind FROM documents),
f AS (SELECT doc_id, CASE kind WHEN 0 THEN lpad(k::VARCHAR, 7, '0') || 'X' WHEN 1 THEN 'E' || lpad(k::VARCHAR, 7, '0') END AS issn, k FROM a),
m AS (SELECT * FROM j WHERE year = (SELECT max(year) FROM j)), c AS (SELECT * FROM j WHERE year = (SELECT max(year) FROM j WHERE k % 2 = 0) AND k % 2 = 0), x AS (SELECT * FROM j WHERE year = (SELECT max(year) FROM j WHERE k % 5 > 0) AND k % 5 > 0)
SELECT f.doc_id, m.jif, CASE WHEN m.q IN ('Q1', 'Q2', 'Q3', 'Q4') THEN m.q END AS quartile, (c.k % 4 + 1)::INTEGER AS partition, c.k % 4 = 0 AS top, (x.k % 4 + 1)::INTEGER AS newer, x.k % 3 = 0 AS under_review,
upper(p.p_brand) IN (SELECT upper(p_brand) FROM part WHERE p_retailprice < 905) AS warned, upper(p.p_brand) IN (SELECT upper(p_brand) FROM part WHERE p_size = 1) AS risky
FROM f JOIN part p ON p.p_partkey = f.k LEFT JOIN m ON f.issn IN (m.issn, m.eissn) LEFT JOIN c ON f.issn IN (c.issn, c.eissn) LEFT JOIN x ON f.issn IN (x.issn, x.eissn)""")
def journal_enrichment(spark, d):
    """Articles of a search with impact, both partitions, warnings and risk of their journals, by ISSN, eISSN and name."""
    part = t(spark, d, "part")
    k = F.col("p_partkey")
    own = F.lpad(k.cast("string"), 7, "0")
    journals = part.select(k.alias("k"), F.concat(F.left(own, F.lit(4)), F.lit("-"), F.right(own, F.lit(3)), F.lit("x")).alias("issn"), F.concat(F.lit("e"), F.left(own, F.lit(3)), F.lit(" "), F.right(own, F.lit(4))).alias("eissn"), F.col("p_size").alias("year"), F.col("p_retailprice").alias("jif"), F.concat(F.lit("Q"), k % 6).alias("jif_quartile"), F.col("p_brand").alias("journal_name"), (k % 4 + 1).alias("major_quartile"), (k % 4 == 0).alias("is_top"), (k % 3 == 0).alias("is_under_review"))
    n = part.count()
    docs = t(spark, d, "documents").withColumn("k", F.col("doc_id") % n)
    asked = docs.join(journals.select("k", "issn", "eissn", "journal_name"), "k")
    issn = F.when(F.col("doc_id") % 3 == 0, F.upper("issn")).when(F.col("doc_id") % 3 == 1, F.upper("eissn"))
    batch = asked.select(F.col("doc_id").alias("ord"), F.lit(None).cast("string").alias("doi"), F.lit("t").alias("title"), F.col("text").alias("abstract"), F.lit("a").alias("authors"), F.concat(F.lit(" "), "journal_name").alias("journal"), issn.alias("issn"), F.lit(2000).alias("year"), F.col("n_chars").alias("citations"), F.lit(True).alias("is_open_access"), F.lit(None).cast("string").alias("url"), "source")
    found = literature.search(batch, journals, journals.filter("jif < 905"), batch.select("doi"), 2**31 - 1, partitions=journals.filter("k % 2 = 0"), newer=journals.filter("k % 5 > 0"), risky=journals.filter("year = 1"))
    return found.select(F.col("ord").alias("doc_id"), "metric.jif", "metric.quartile", "cas.partition", "cas.top", "xr.newer", "xr.under_review", "warned", "risky")


@query("""WITH p AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'figshare' ELSE 'osf' END AS source, doc_id // 2 AS ord, left(md5(text), 10) AS id, 1990 + doc_id % 30 AS y, doc_id % 3 AS l FROM documents),
q AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ord) AS n FROM p QUALIFY n <= 250),
u AS (SELECT *, ord * 2 + CASE source WHEN 'figshare' THEN 0 ELSE 1 END AS o FROM q WHERE source = 'figshare' OR TRUE),
k AS (SELECT *, source || ':' || id AS key FROM u), f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY o) AS rn FROM k QUALIFY rn = 1)
SELECT o AS ord, key AS dedup_key, y::VARCHAR AS year FROM f WHERE y BETWEEN 1995 AND 2010 AND l = 1 ORDER BY o LIMIT 500""")
def domain_search(spark, d):
    """3.4, P01, P02, S16: one domain over recorded payloads, with gates, quota, merge and filters."""
    even = F.col("doc_id") % 2 == 0
    payload = F.to_json(F.struct(F.left(F.md5("text"), F.lit(10)).alias("id"), F.element_at(F.split("text", "\n", 2), 1).alias("title"), (1990 + F.col("doc_id") % 30).cast("string").alias("year"), F.when(F.col("doc_id") % 3 == 1, "CC-BY 4.0").otherwise("CC0").alias("license")))
    recorded, root = t(spark, d, "documents").select(F.when(even, "figshare").otherwise("osf").alias("source"), F.floor(F.col("doc_id") / 2).alias("ord"), payload.alias("payload")), _scratch(spark)
    payloads.write(recorded, root)
    found = payloads.read(spark, root, ["figshare", "osf"]).filter("error is null").select("source", "ord", "payload")
    rows, _ = domains.search(spark, found, "dataset", 500, {"year": "1995-2010", "license": "CC BY"}, chosen=["figshare", "osf"])
    return rows.select("ord", "dedup_key", "year")


@query("""WITH s AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'Global Letters Physics' WHEN s_suppkey % 3 = 1 THEN 'Annals of Fake Biology' ELSE 'Quiet ' || s_name END AS journal FROM supplier)
SELECT id, CASE id % 3 WHEN 0 THEN 'keyword' WHEN 1 THEN 'exact' END AS layer, CASE id % 3 WHEN 0 THEN 0.7 WHEN 1 THEN 1.0 END::DOUBLE AS confidence FROM s""")
def predatory_check(spark, d):
    """Layered match against risk lists."""
    s = F.col("s_suppkey") % 3
    items = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(s == 0, "Global Letters Physics").when(s == 1, "annals of  fake biology").otherwise(F.concat(F.lit("Quiet "), "s_name")).alias("journal"), F.lit(None).cast("string").alias("publisher"), F.lit(None).cast("string").alias("url"))
    lists = spark.createDataFrame([("Annals of Fake Biology", None, "AFB"), ("Global Letters of Chemistry", None, None)], "name string, url string, abbr string")
    none = spark.createDataFrame([], "name string, url string")
    return risk.check(items, lists, none, none).select("id", "layer", "confidence")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_daily_usage(spark, d):
    """Daily usage from a stream of event files."""
    root = _scratch(spark)
    schema = t(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parquet") if _is_folder(spark, f"{d}/events.parquet") else _staged(spark, t(spark, d, "events"), root)
    table = feeds.Snapshots(spark, f"{root}/daily", "day string, event_type string, n long, total double")
    counted = stream.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    last = []
    counted.writeStream.outputMode("complete").foreachBatch(lambda b, n: (table.write(b, n), last.append(n))).option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start().awaitTermination()
    return table.read(max(last)).select("day", "event_type", "n", r("total").alias("total"))


def _is_folder(spark, path: str) -> bool:
    """Whether the table is a folder of files, asked of Spark's own file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _staged(spark, df, root: str):
    df.write.parquet(f"{root}/in")
    return spark.readStream.schema(df.schema).parquet(f"{root}/in")


@query("""WITH a AS (SELECT doc_id AS ord, CASE WHEN doc_id % 4 > 0 THEN '10.1/' || left(md5(text), 12) END AS doi, split_part(text, chr(10), 1) AS title, n_chars AS citations FROM documents)
SELECT min(ord) AS ord, arg_max(title, (length(title), -ord)) AS title, max(citations) AS citations FROM a GROUP BY coalesce(doi, ord::VARCHAR)""")
def stream_progressive_merge(spark, d):
    """Batches of one search merged by DOI as they arrive; another search's batches are dropped."""
    root = _scratch(spark)
    rows = t(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("10.1/"), F.left(F.md5("text"), F.lit(12)))).alias("doi"), F.element_at(F.split("text", "\n", 2), 1).alias("title"), F.col("n_chars").alias("citations"), F.array("source").alias("sources"), F.lit("now").alias("search_id"))
    both = rows.unionByName(rows.withColumn("search_id", F.lit("old")).withColumn("citations", F.lit(10**9).cast("long")))
    both.repartition(3, "ord").write.parquet(f"{root}/in")
    table = feeds.merged_table(spark, f"{root}/merged", 16)
    feeds.run(feeds.files(spark, f"{root}/in", "ord long, doi string, title string, citations long, sources array<string>, search_id string"), f"{root}/ckpt", feeds.progressive_merge(table, "now"))
    return table.read().select("ord", "title", "citations")


@query("""WITH e AS (SELECT user_id, ts, coalesce(value, 0) AS v FROM events WHERE user_id IS NOT NULL AND ts < (SELECT max(ts) FROM events) - INTERVAL 2 HOUR)
SELECT user_id, count(*) AS n, round(sum(v), 4) AS total FROM e GROUP BY user_id""")
def stream_flushes(spark, d):
    """Usage by user, buffered and flushed by count or time; up to two hours before the end, by when every buffer is flushed."""
    root = _scratch(spark)
    events = t(spark, d, "events").filter("user_id is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    last = events.agg(F.max("ts")).first()[0]
    early = events.filter(F.col("ts") < F.lit(last) - F.expr("interval 2 hours")) if last else events
    early.select("user_id", "ts", "value").sortWithinPartitions("ts").repartitionByRange(3, "ts").write.parquet(f"{root}/in/a")
    # the last event moves the watermark on, so that no buffer stays open
    events.filter(F.col("ts") == F.lit(last)).limit(1).select(F.lit(-1).cast(events.schema["user_id"].dataType).alias("user_id"), "ts", "value").write.parquet(f"{root}/in/b")
    schema = events.select("user_id", "ts", "value").schema
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/in")
    # one batch for all files: what order they come in does not matter then
    flushes = feeds.flushed(stream, "user_id", "ts", "value", seconds=3600)
    flushes.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.schema("key long, flush long, n long, total double").parquet(f"{root}/out").filter("key >= 0")
    return kept.groupBy(F.col("key").cast(events.schema["user_id"].dataType).alias("user_id")).agg(F.sum("n").alias("n"), r(F.sum("total")).alias("total"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 3 <> 0")
def stream_deletes(spark, d):
    """Delete events cascade to the index."""
    root = _scratch(spark)
    index = t(spark, d, "embeddings").select("vec_id", "label")
    index.filter("vec_id % 3 = 0").select("vec_id").repartition(2).write.parquet(f"{root}/in")
    table, last = feeds.Snapshots(spark, f"{root}/index", "vec_id long, label int"), []
    step = feeds.cascade_deletes(table, index, "vec_id")
    feeds.run(feeds.files(spark, f"{root}/in", "vec_id long"), f"{root}/ckpt", lambda b, n: (step(b, n), last.append(n)))
    return table.read(max(last)).select("vec_id", "label")


@query(r"""WITH s AS (SELECT doc_id AS ord, unnest(list_concat(list_filter(list_concat(coalesce(string_split(text, ' ')[1:5], []), [lang]), lambda x: length(x) BETWEEN 2 AND 60),
  coalesce(regexp_extract_all(text, '\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b', 1), []))) AS signal FROM documents)
SELECT signal, min(ord) AS ord FROM s GROUP BY signal""")
def review_signals(spark, d):
    """What reviews name, for follow-up queries."""
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.col("text").alias("title"), F.split("text", " ").alias("tags"), F.col("lang").alias("domain"))
    return literature.review_signals(docs).select("signal", "ord")
