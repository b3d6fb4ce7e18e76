"""Federated literature search and its multi-round form, as lazy plans."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dialects as D
from ..functions import normalize as N
from ..functions import scoring as C
from ..functions import text as X
from ..operators import dedup, filters, joins, usage


def merge(batches: DataFrame) -> DataFrame:
    """Articles of all sources as one row for each DOI, in arrival order.

    Rows need ord, doi, title, abstract, authors, journal, year, citations,
    is_open_access, url and source; an issn is kept where there is one.
    """
    rows = batches.withColumn("sources", F.array("source"))
    own = [c for c in ("issn",) if c in batches.columns]
    return dedup.merge_articles(rows, N.doi("doi"), fill=["doi", "authors", "journal", "url", "source", *own], long=["title", "abstract"], most=["citations", "is_open_access"], least=["year"])


def _latest(table: DataFrame) -> DataFrame:
    """The rows of a table's last year."""
    return table.join(F.broadcast(table.agg(F.max("year").alias("_y"))), F.col("year") == F.col("_y")).drop("_y")


def _metric(articles: DataFrame, table: DataFrame, values: Sequence[Column], name: str) -> DataFrame:
    """``articles`` with a table's values of their journal: by ISSN or eISSN where both sides have one, else by name."""
    last = _latest(table)
    if "issn" in articles.columns and "issn" in last.columns:
        eissn = F.col("eissn") if "eissn" in last.columns else F.lit(None).cast("string")
        keyed = last.select(N.issn("issn").alias("_i"), N.issn(eissn).alias("_e"), "year", *values)
        return joins.lookup(articles, N.issn("issn"), keyed, [F.col("_i"), F.col("_e")], "year", name)
    keyed = last.select(N.journal_name("journal_name").alias("_n"), "year", *values)
    return joins.lookup(articles, N.journal_name("journal"), keyed, [F.col("_n")], "year", name)


def enrich(articles: DataFrame, metrics: DataFrame, warnings: DataFrame, partitions: DataFrame | None = None, newer: DataFrame | None = None, risky: DataFrame | None = None) -> DataFrame:
    """What the journal tables say of each article's journal.

    Impact (jif, quartile), partitions (partition, top) and newer partitions
    (newer, under_review) of their latest years are found by ISSN, warnings and risk
    lists by name.  A missing table, key or match gives nulls or false.
    """
    out = _metric(articles, metrics, [F.col("jif"), N.quartile("jif_quartile").alias("quartile")], "metric")
    if partitions is not None:
        out = _metric(out, partitions, [F.col("major_quartile").cast("int").alias("partition"), F.col("is_top").alias("top")], "cas")
    if newer is not None:
        out = _metric(out, newer, [F.col("major_quartile").cast("int").alias("newer"), F.col("is_under_review").alias("under_review")], "xr")
    out = joins.mark(out, N.journal_name("journal"), warnings, N.journal_name("journal_name"), "warned")
    return out if risky is None else joins.mark(out, N.journal_name("journal"), risky, N.journal_name("journal_name"), "risky")


def score(articles: DataFrame, as_of_year: int) -> DataFrame:
    """The weighted total of citations, journal, recency and peer review."""
    has = lambda table, value, kind: F.col(f"{table}.{value}") if table in articles.columns else F.lit(None).cast(kind)
    tier = C.journal_tier(F.col("warned"), F.col("metric.quartile"), has("cas", "partition", "int"), has("cas", "top", "boolean"))
    total = C.half_up(0.33 * C.citation_band("citations") + 0.33 * tier + 0.17 * C.recency("year", as_of_year) + 0.17 * C.peer_review(F.lit("journalarticle"), F.col("doi").isNotNull()))
    return articles.withColumn("score", total)


def search(batches: DataFrame, metrics: DataFrame, warnings: DataFrame, library: DataFrame, most: int, open_access: bool = False, words: str | None = None, partitions: DataFrame | None = None, newer: DataFrame | None = None, risky: DataFrame | None = None) -> DataFrame:
    """union, merge, filter, enrich, cap and mark: one plan, in that order."""
    rows = merge(batches)
    if open_access:
        rows = rows.filter("is_open_access")
    if words:
        rows = rows.filter(X.holds_every_word(F.concat_ws(" ", "title", "authors", "journal", "abstract"), F.lit(words)))
    rows = enrich(rows, metrics, warnings, partitions, newer, risky).orderBy("ord").limit(most)
    return joins.mark(rows, N.doi("doi"), library, N.doi("doi"))


def deep_search(spark: SparkSession, first: Sequence[str], fetch: Callable[[DataFrame], DataFrame], scores: DataFrame, checkpoint: Callable[[DataFrame], DataFrame], rounds: int = 3, threshold: float = 50, most: int = 100) -> tuple[DataFrame, DataFrame]:
    """(papers, buckets) of several rounds of fetching, scoring and query growth.

    ``fetch`` turns a (query, round) table into articles with url, doi, title
    and abstract; ``scores`` holds recorded evaluations by cross-stage key.  A
    round's new queries are title terms of its best papers: at most five short
    texts reach the driver between rounds.
    """
    asked: set[str] = set()
    queries, kept = list(first), None
    for n in range(min(rounds, 5)):
        queries = [q for q in dict.fromkeys(x.strip().lower() for x in queries) if q and q not in asked][:5]
        if not queries:
            break
        asked.update(queries)
        found = fetch(spark.createDataFrame([(q, n) for q in queries], "query string, round int"))
        found = found.withColumn("key", N.stage_key("doi", "url"))
        found = dedup.latest(found.filter("key is not null"), ["key"], [F.col("query"), F.col("url")])
        if kept is not None:
            found = found.join(kept.select("key"), "key", "left_anti")
        heuristic = C.search_result_score(F.col("title"), F.coalesce("abstract", F.lit("")), F.col("url"), F.coalesce("citations", F.lit(0)))
        judged = found.join(scores, "key", "left").withColumn("heuristic", heuristic).withColumn("score", F.coalesce(C.fuse(F.col("ai_score"), F.col("heuristic")), F.col("heuristic").cast("long")))
        passed = checkpoint(judged.filter(F.col("score") >= threshold).drop("ai_score", "heuristic"))
        kept = passed if kept is None else checkpoint(kept.unionByName(passed))
        best = passed.orderBy(F.desc("score"), "key").limit(5).select("title").collect()  # five titles
        queries = [" ".join(r["title"].split()[:4]) for r in best if r["title"]]
    papers = kept.orderBy(F.desc("score"), "key").limit(most)
    return papers, usage.score_buckets(papers, "score")


# ---- fixed values: what counts as a technical term in a title, and how many signals a seed set may have
TECHNICAL_TERM = r"(?<![A-Za-z0-9_])([A-Z][a-z]+(?:[A-Z][a-z]+)+)(?![A-Za-z0-9_])"
MOST_SIGNALS = 10_000


def review_signals(reviews: DataFrame) -> DataFrame:
    """Distinct (signal, ord) of reviews (ord, title, tags, domain), ord that of the first one.

    Signals are the first five tags and the domain, of 2 to 60 characters each,
    and technical terms in the title.  Null columns give none.
    """
    none = F.array().cast("array<string>")
    named = F.filter(F.concat(F.coalesce(F.slice("tags", 1, 5), none), F.array("domain")), lambda x: F.length(x).between(2, 60))
    terms = F.coalesce(F.regexp_extract_all("title", F.lit(TECHNICAL_TERM), F.lit(1)), none)
    found = reviews.select("ord", F.posexplode(F.concat(named, terms)).alias("k", "signal"))
    return found.groupBy("signal").agg(F.min(F.struct("ord", "k")).alias("at")).select("signal", "at.ord", "at.k")


def review_queries(reviews: DataFrame, query: str, most: int = 5) -> list[str]:
    """Queries that follow up what a search's reviews name, alike ones once.

    The reviews are one search's results; more than MOST_SIGNALS signals are an error.
    """
    signals = [row.signal for row in review_signals(reviews).orderBy("ord", "k").limit(MOST_SIGNALS + 1).collect()]
    if len(signals) > MOST_SIGNALS:
        raise ValueError(f"more than {MOST_SIGNALS} signals: these are not the reviews of one search")
    return D.distinct_queries([f"{s} {query}" for s in signals])[:most]
