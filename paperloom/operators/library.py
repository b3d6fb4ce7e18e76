"""Library items: search texts, badges, scoped and enriched retrieval, discovery."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import scoring as C
from ..functions import text as X
from . import joins

# ---- fixed values: how much of an item's fields its search text holds
MOST_NOTE, MOST_TEXT, MOST_ABSTRACT, MOST_CREATORS, MOST_TAGS = 2000, 3000, 1500, 10, 15


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def search_text(kind: Column, title: Column, creators: Column, date: Column, abstract: Column, venue: Column, tags: Column, note: Column, comment: Column) -> Column:
    """What is embedded of an item: notes and annotations their own text, others their fields by line."""
    joined = lambda words, most: N.missing(F.array_join(F.slice(F.filter(words, lambda w: F.trim(w) != ""), 1, most), ", "))
    fields = [N.missing(title), joined(creators, MOST_CREATORS), N.missing(F.left(date, F.lit(4))), N.missing(F.left(abstract, F.lit(MOST_ABSTRACT))), N.missing(venue), joined(tags, MOST_TAGS)]
    whole = F.left(F.concat_ws("\n", *(F.trim(f) for f in fields)), F.lit(MOST_TEXT))
    plain = F.left(F.regexp_replace(F.coalesce(note, F.lit("")), "<[^>]+>", " "), F.lit(MOST_NOTE))
    marked = F.left(F.concat_ws("\n", N.missing(X.strip_markup(note)), N.missing(X.strip_markup(comment))), F.lit(MOST_NOTE))
    return F.when(kind == "note", plain).when(kind == "annotation", marked).otherwise(whole)


def badges(metrics: DataFrame, partitions: DataFrame, newer: DataFrame, warned: DataFrame, listed: DataFrame) -> DataFrame:
    """One row for each journal name that any of five tables knows, with what each says.

    metrics has journal_name, year, jif and jif_quartile, partitions journal_name,
    year, major_quartile and is_top, newer journal_name, year and major_quartile;
    of each only the latest year counts.  All tables meet in one aggregation.
    """

    def last(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(df.agg(F.max("year").alias("_y"))), F.col("year") == F.col("_y"))

    def part(df: DataFrame, **said: Column) -> DataFrame:
        kinds = {"jif": "double", "quartile": "string", "partition": "int", "top": "boolean", "newer": "int", "warning": "boolean", "predatory": "boolean"}
        return df.select(N.journal_name("journal_name").alias("name"), *(said.get(k, F.lit(None)).cast(v).alias(k) for k, v in kinds.items()))

    quartile = N.quartile("jif_quartile")
    every = part(last(metrics).filter("jif is not null or jif_quartile is not null"), jif=F.col("jif"), quartile=quartile)
    every = every.unionByName(part(last(partitions).filter("major_quartile is not null"), partition=F.col("major_quartile"), top=F.coalesce("is_top", F.lit(False))))
    every = every.unionByName(part(last(newer).filter("major_quartile is not null"), newer=F.col("major_quartile")))
    every = every.unionByName(part(warned, warning=F.lit(True))).unionByName(part(listed, predatory=F.lit(True)))
    return every.filter("name is not null").groupBy("name").agg(*(F.max(c).alias(c) for c in every.columns[1:]))


def items_by_field(items: DataFrame, fields: DataFrame, values: DataFrame, data: DataFrame, field: str, wanted: DataFrame, normal: Callable[[Column], Column]) -> DataFrame:
    """(item_id, value) of live items whose field has a wanted value, from an entity-attribute-value store.

    items has item_id and deleted, fields field_id and name, values value_id and
    value, data item_id, field_id and value_id, wanted value.
    """
    own = F.broadcast(fields.filter(F.col("name") == field).select("field_id"))  # a field has one id
    keys = wanted.select(normal(F.col("value")).alias("key")).filter("key is not null").distinct()
    hit = values.select("value_id", normal(F.col("value")).alias("key")).join(keys, "key", "left_semi")
    return data.join(own, "field_id").join(hit, "value_id").join(items.filter("not deleted"), "item_id", "left_semi").select("item_id", F.col("key").alias("value"))


def in_scope(rows: DataFrame, members: DataFrame | None, key: str) -> DataFrame:
    """Rows of a collection's members; without a collection, all."""
    return rows if members is None else rows.join(members.select(key).distinct(), key, "left_semi")


def present(hits: DataFrame, chunks: DataFrame, items: DataFrame, snippet: int = 200) -> DataFrame:
    """Ranked hits (item_id, chunk_id, rank) with their chunk and their item; hits on deleted items go."""
    text = chunks.select(F.col("id").alias("chunk_id"), "section_name", F.left("chunk_text", F.lit(snippet)).alias("snippet"))
    live = items.filter(~F.coalesce("deleted", F.lit(False))).select("item_id", "title", "type", "doi")
    return hits.join(text, "chunk_id", "left").join(live, "item_id")


def with_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks that have a vector, with it."""
    return chunks.join(vectors.select(F.col("chunk_id").alias("id"), "embedding"), "id")


def best_chunks(hits: DataFrame, limit: int, section: str | None = None, late: bool = False) -> DataFrame:
    """Best chunk of each item out of an over-fetched list (id, item_id, section, score).

    max(5 limit, 50) chunks are fetched, three times as many with a section.
    ``late`` tests the section after that cut, as a text index without sections
    does; then fewer items may remain.
    """
    many = max(5 * limit, 50) * (3 if section else 1)
    rows = hits if section is None or late else hits.filter(F.col("section") == section)
    rows = rows.orderBy(F.desc("score"), "id").limit(many)
    rows = rows.filter(F.col("section") == section) if section and late else rows
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "id")
    rows = rows.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")
    return rows.orderBy(F.desc("score"), "id").limit(limit)


def rerank(hits: DataFrame, scores: DataFrame | None, replace: bool, limit: int) -> DataFrame:
    """Ranked hits (rank, text, score) in the order of recorded rerank scores (rank, rerank).

    Blank texts are not scored and follow in their order; with ``replace`` the
    rerank score takes the place of the score.  Without scores the order stays
    and every row is flagged.
    """
    if scores is None:
        return hits.orderBy("rank").limit(limit).withColumn("rerank_unavailable", F.lit(True))
    s = scores.select("rank", "rerank")
    out = hits.join(s, "rank", "left").withColumn("rerank", F.when(N.missing("text").isNotNull(), F.col("rerank")))
    out = out.orderBy(F.desc_nulls_last("rerank"), "rank").limit(limit)
    shown = F.coalesce("rerank", "score") if replace else F.col("score")
    return out.withColumn("score", shown).drop("rerank").withColumn("rerank_unavailable", F.lit(False))


def discover(local: DataFrame, external: DataFrame, order: str, checkpoint: Callable[[DataFrame], DataFrame], most_local: int = 10) -> DataFrame:
    """Local journals first, then external ones whose ISSN and name no row before has.

    Both have name, issn and ``order``.  Whether a row stays depends on which of
    the rows before it stayed, under either key: inserts under two unique keys.
    """
    from . import mutation

    keyed = lambda df: df.withColumn("_issn", N.issn("issn")).withColumn("_name", N.journal_name("name"))
    first = keyed(local.orderBy(order).limit(most_local))
    rest = keyed(external)
    said = mutation.insert_absent_any(first, rest, [["_issn"], ["_name"]], order, checkpoint)
    kept = rest.join(said.filter("status = 'inserted'").select(order), order)
    return first.withColumn("place", F.lit(0)).unionByName(kept.withColumn("place", F.lit(1)), allowMissingColumns=True).drop("_issn", "_name")


def discover_order(kind: str) -> list[Column]:
    """Local first, or by a number whose absence counts as -1."""
    key = {"relevance": [], "jif": [F.desc(F.coalesce("jif", F.lit(-1.0)))], "works": [F.desc(F.coalesce("works", F.lit(-1)))], "hindex": [F.desc(F.coalesce("hindex", F.lit(-1)))]}[kind]
    return [*key, F.asc("place"), F.asc("ord")]


def cited(edges: DataFrame, seeds: DataFrame, direction: str, papers: DataFrame, most: int) -> DataFrame:
    """(seed, id, title) one hop along citation edges (citing, cited), at most ``most`` for each seed by id."""
    frm, to = ("citing", "cited") if direction == "references" else ("cited", "citing")
    hop = edges.select(F.col(frm).alias("seed"), F.col(to).alias("id")).distinct().join(seeds.select(F.col("id").alias("seed")).distinct(), "seed", "left_semi")
    hop = hop.withColumn("_n", F.row_number().over(Window.partitionBy("seed").orderBy("id"))).filter(F.col("_n") <= most).drop("_n")
    return hop.join(papers.select("id", "title"), "id").select("seed", "id", "title")


# ---- fixed values: the least model score of a discovered paper, and where scores are cut
LEAST_SCORE = 40


def discovered(papers: DataFrame, judged: DataFrame) -> DataFrame:
    """Papers that the model scored ``LEAST_SCORE`` or more, by their fused score.

    papers has pos, title, abstract, url and citations; judged has pos, ai_score,
    paper_type and reason.  A verdict on no paper is dropped with its position.
    """
    heuristic = C.search_result_score(F.col("title"), F.coalesce("abstract", F.lit("")), F.col("url"), F.coalesce("citations", F.lit(0)))
    rows = judged.filter(F.col("ai_score") >= LEAST_SCORE).join(papers, "pos").withColumn("heuristic", heuristic)
    return rows.withColumn("score", C.fuse(F.col("ai_score"), F.col("heuristic"))).withColumn("paper_type", F.coalesce("paper_type", F.lit("research"))).orderBy(F.desc("score"), "pos")


def best_of(heuristic: Column, academic: Column) -> Column:
    """The higher of both scores; the academic one complements the other."""
    return F.greatest(heuristic, academic)


def page_link(url: Column | str) -> Column:
    """A URL that may hold a readable page: http, no PDF, no PubMed abstract; else null."""
    u = _column(url)
    bad = u.rlike(r"(?i)\.pdf(?:$|[?#])") | u.rlike(r"(?i)^https?://(?:www\.)?pubmed\.ncbi\.nlm\.nih\.gov/")
    return F.when(u.rlike(r"(?i)^https?://") & ~bad, u)


def is_specific(query: Column | str) -> Column:
    """Queries that are not rewritten: a DOI, a quoted title, a URL, or under five characters."""
    q = F.trim(_column(query))
    return q.rlike(r"^10\.\d{4,}") | q.rlike(r'^".+"$') | q.rlike("^https?://") | (F.length(q) < 5)


def by_language(primary: str, columns: dict[str, Column], sentinel: str) -> Column:
    """The text in the primary language, else in another, else a sentinel."""
    order = [primary, *(k for k in columns if k != primary)]
    return F.coalesce(*(N.missing(columns[k]) for k in order), F.lit(sentinel))


def index_valid(stored: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """(valid,): whether a stored index (rows, model, dimension) agrees with the vectors of a model."""
    now = vectors.filter(F.col("model") == model).agg(F.count("*").alias("_n"), F.max(F.size("embedding")).alias("_d"), F.min(F.size("embedding")).alias("_e"))
    same = (F.col("rows") == F.col("_n")) & (F.col("model") == model) & (F.col("_n") == 0) | ((F.col("rows") == F.col("_n")) & (F.col("model") == model) & (F.col("dimension") == F.col("_d")) & (F.col("dimension") == F.col("_e")))
    return stored.crossJoin(F.broadcast(now)).select(F.coalesce(same, F.lit(False)).alias("valid"))  # now: one row


def reveal(df: DataFrame, order: Sequence[Column], shown: int, step: int) -> DataFrame:
    """The next ``step`` rows after the ``shown`` first ones."""
    return df.orderBy(*order).offset(shown).limit(step)


# ---- fixed values: named entities of XML
XML_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")]


def xml_text(c: Column | str) -> Column:
    """Text with XML's five named and all numeric entities decoded; the ampersand comes last."""
    out = _column(c)
    for name, char in XML_ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    parts = F.split(out, "&#", -1)

    def decoded(part: Column) -> Column:
        digits = F.regexp_extract(part, r"^([xX][0-9a-fA-F]{1,6}|[0-9]{1,7});", 1)
        code = F.when(F.lower(F.left(digits, F.lit(1))) == "x", F.conv(F.substring(digits, 2, 7), 16, 10)).otherwise(digits).try_cast("int")
        bytes4 = F.unhex(F.lpad(F.hex(code), 8, "0"))
        known = (digits != "") & code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(known, F.concat(F.decode(bytes4, "UTF-32"), F.substr(part, F.length(digits) + 2))).otherwise(F.concat(F.lit("&#"), part))

    body = F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), decoded), ""))
    return F.replace(body, F.lit("&amp;"), F.lit("&"))


def highlighted(c: Column | str, words: list[str], begin: str = "[", end: str = "]") -> Column:
    """Every hit of any word between marks, longest word first, whatever the case."""
    import re

    found = "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))
    return F.regexp_replace(_column(c), f"(?i)({found})", f"{begin}$1{end}")


def citation_list(df: DataFrame, order: str) -> DataFrame:
    """(n, block): numbered citation texts; fields that are missing are skipped."""
    line = lambda label, c: F.concat(F.lit(f"{label}: "), N.missing(F.col(c).cast("string")))
    n = df.withColumn("n", F.row_number().over(Window.orderBy(order)))  # the list that one reader exports
    return n.select("n", F.concat_ws("\n", F.concat(F.lit("["), F.col("n"), F.lit("] "), F.coalesce(N.missing("title"), F.lit("Untitled"))), line("Authors", "authors"), line("Journal", "journal"), line("Year", "year"), line("DOI", "doi")).alias("block"))


def mark_known(rows: DataFrame, library: DataFrame) -> DataFrame:
    """Rows with whether their DOI, or else their patent number, is in the library."""
    doi = joins.mark(rows, N.doi("doi"), library, N.doi("doi"), "_d")
    both = joins.mark(doi, N.patent("patent"), library, N.patent("patent"), "_p")
    return both.withColumn("in_library", F.col("_d") | F.col("_p")).drop("_d", "_p")
