"""Query texts for single sources: driver-side strings, and columns of one query for several engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CJK = re.compile(r"[一-鿿]")
# ---- fixed values: how each variant of a query term reads
VARIANTS = ("systematic review", "latest advances", "methodology comparison")


def bare(phrase: str | None) -> str:
    """A phrase that can stand between quotes."""
    return re.sub(r"\s+", " ", (phrase or "").replace('"', " ")).strip()


def _quoted(parts: list[tuple[str, str | None]]) -> list[str]:
    return [shape.format(p) for shape, text in parts if (p := bare(text))]


def arxiv(query: str, author: str | None = None, title: str | None = None, abstract: str | None = None, year: str | None = None) -> str:
    base = f"{query} au:{author}" if author else query
    years = re.fullmatch(r"(\d{4})(?:\s*-\s*(\d{4}))?", year or "")
    parts = [f"all:{base}"] if base else []
    parts += _quoted([('ti:"{}"', title), ('abs:"{}"', abstract)])
    if years:
        parts.append(f"submittedDate:[{years[1]}01010000 TO {years[2] or years[1]}12312359]")
    return " AND ".join(parts) if parts else f"all:{base}"


def _with_clauses(query: str, clauses: list[str]) -> str:
    return f"({query}) AND {' AND '.join(clauses)}" if clauses else query


def europe_pmc(query: str, title: str | None = None, abstract: str | None = None, has_abstract: bool = False, reviews: bool = False) -> str:
    return _with_clauses(query, ["pub_type:Review"] * reviews + _quoted([('TITLE:"{}"', title), ('ABSTRACT:"{}"', abstract)]) + ["HAS_ABSTRACT:Y"] * has_abstract)


def pubmed(query: str, title: str | None = None, abstract: str | None = None, has_abstract: bool = False, reviews: bool = False) -> str:
    return _with_clauses(query, ["Review[ptyp]"] * reviews + _quoted([('("{}")[Title]', title), ('("{}")[tiab]', abstract)]) + ["hasabstract[Filter]"] * has_abstract)


def openalex(title: str | None = None, abstract: str | None = None, has_abstract: bool = False, open_access: bool = False) -> str:
    from urllib.parse import quote

    parts = [f"{name}.search:{quote(p, safe='')}" for name, text in (("title", title), ("abstract", abstract)) if (p := bare(text))]
    return ",".join(parts + ["has_abstract:true"] * has_abstract + ["open_access.is_oa:true"] * open_access)


def github(query: str, title: str | None = None) -> str:
    return f"{query} in:title" if bare(title) else query


def plain(query: str, title: str | None = None) -> str:
    """For sources without fields: the title, if there is one, is the query."""
    return bare(title) or query


def expand(query: str, stop_words: frozenset[str] = frozenset(), most: int = 8) -> list[str]:
    """The query and variants of its first three terms: long Latin words, then CJK bigrams."""
    terms = [w for w in re.findall(r"[a-zA-Z][a-zA-Z0-9-]{3,}", query) if w.lower() not in stop_words]
    for run in re.findall(r"[一-鿿]{2,}", query):
        terms += [run[i : i + 2] for i in range(len(run) - 1)]
    out = {query.strip().lower(): query}
    for term in terms[:3]:
        for v in VARIANTS:
            out.setdefault(f"{term} {v}".lower(), f"{term} {v}")
    return list(out.values())[:most]


def _tokens(query: str) -> frozenset[str]:
    han = _CJK.findall(query)
    return frozenset([a + b for a, b in zip(han, han[1:])] + [w.lower() for w in re.findall(r"[a-zA-Z]{3,}|\d+", query)])


def _worth(query: str) -> tuple[bool, int]:
    words = len(re.findall(r"[a-zA-Z]+", query)) + len(_CJK.findall(query))
    return len(query) >= 10 and words >= 2, len(query)


def distinct_queries(queries: list[str], least: float = 0.5) -> list[str]:
    """One query for each cluster of alike ones: the longest telling one, the later among equals.

    Queries are alike if their tokens' Jaccard index is over ``least``; clusters
    are chains of alike queries.
    """
    unique = list({q.strip().lower(): q.strip() for q in reversed(queries) if q.strip()}.values())[::-1]
    left, out = list(unique), []
    while left:
        cluster = [left.pop(0)]
        for q in cluster:
            near = [o for o in left if (a := _tokens(q)) and (b := _tokens(o)) and len(a & b) > least * len(a | b)]
            cluster += near
            left = [o for o in left if o not in near]
        out.append(max(enumerate(sorted(cluster, key=unique.index)), key=lambda p: (*_worth(p[1]), p[0]))[1])
    return out


# ---- the same query for several engines, as columns


def adapted(queries: DataFrame, headings: DataFrame, stop_words: list[str], noise: list[str], query: str = "query", id_col: str = "id") -> DataFrame:
    """``queries`` with openalex, arxiv, pubmed and europe_pmc texts made from their keywords.

    headings has term (lower case) and names (a list): the subject headings that
    stand for a keyword.  Keywords are Latin words of three letters or more that
    are no stop words; arXiv also leaves out ``noise``.  A query without keywords
    stays as it is.  Null queries give nulls; ids are unique.
    """
    low = lambda words: F.array(*map(F.lit, words)).cast("array<string>")
    without = lambda words, out: F.filter(words, lambda w: ~F.array_contains(low(out), F.lower(w)))
    rows = queries.withColumn("_words", without(F.regexp_extract_all(query, F.lit(r"([a-zA-Z][a-zA-Z0-9-]{2,})"), F.lit(1)), stop_words))
    asked = rows.select(F.col(id_col).alias("_q"), F.posexplode(F.slice("_words", 1, 6)).alias("_pos", "_word"))
    named = headings.select(F.col("term").alias("_term"), F.array_join(F.transform("names", lambda n: F.concat(F.lit('"'), n, F.lit('"[MeSH Terms]'))), " OR ").alias("_mesh"))
    met = asked.join(named, F.lower("_word") == F.col("_term"), "left")
    quoted = lambda where: F.concat(F.lit('"'), F.col("_word"), F.lit(f'"[{where}]'))
    with_heading = F.concat(F.lit("("), F.col("_mesh"), F.lit(") AND "), quoted("Title/Abstract"))
    terms = met.groupBy("_q").agg(*(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_pos", F.coalesce(with_heading, quoted(where)).alias("t")))), lambda s: s["t"]), " AND ").alias(name) for name, where in (("pubmed", "All Fields"), ("europe_pmc", "Title/Abstract"))))
    text = lambda words, most: F.coalesce(F.nullif(F.array_join(F.slice(words, 1, most), " "), F.lit("")), F.col(query))
    out = rows.withColumn("openalex", text(F.col("_words"), 8)).withColumn("arxiv", text(without(F.col("_words"), noise), 5)).join(terms, F.col(id_col) == F.col("_q"), "left")
    return out.withColumns({c: F.coalesce(c, query) for c in ("pubmed", "europe_pmc")}).drop("_q", "_words")
