"""Records and sections out of XML, and a test for texts that are no prose."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import _col, doi, missing
from ..operators.chunking import heading

#: Most characters of a packed paragraph chunk.
LONGEST = 2000


def atom_records(df: DataFrame, xml: str = "xml") -> DataFrame:
    """One row for each entry of Atom feeds in a text column: id, title, authors and more."""
    entry = F.explode(F.regexp_extract_all(F.col(xml), F.lit(r"(?s)(<entry\b.*?</entry>)"), 1))
    flat = df.select(entry.alias("e")).select(F.regexp_replace(F.regexp_replace("e", r"\sxmlns(:\w+)?=\"[^\"]*\"", ""), r"(</?)\w+:", "$1").alias("e"))
    one = lambda path: missing(F.regexp_replace(F.xpath_string("e", F.lit(f"entry/{path}")), r"\s+", " "))
    rows = flat.select(
        one("id").alias("url"), F.trim(one("title")).alias("title"), F.array_join(F.xpath("e", F.lit("entry/author/name/text()")), ", ").alias("authors"), F.trim(one("summary")).alias("abstract"),
        F.left(one("published"), F.lit(4)).try_cast("int").alias("year"), doi(F.xpath_string("e", F.lit("entry/doi"))).alias("doi"), one("link[@title='pdf']/@href").alias("pdf_url"),
    )
    return rows.filter("title is not null")


def is_page_garbage(c: Column | str) -> Column:
    """Too short, mostly code characters, or mostly template variables."""
    c = F.coalesce(_col(c), F.lit(""))
    code = F.regexp_count(c, F.lit(r"[{}();:@#.%<>\[\]]"))
    holes, words = F.regexp_count(c, F.lit(r"\{\{")), F.size(F.split(c, r"\s+"))
    return (F.length(c) < 100) | (code > 0.3 * F.length(c)) | ((holes > 5) & (holes > words / 10))


def pack_paragraphs(text: str, most: int = LONGEST) -> list[str]:
    """Neighbouring paragraphs together while they fit; one that does not fit stands alone."""
    out: list[str] = []
    for p in (p for p in text.split("\n") if p.strip()):
        if out and len(out[-1]) + 1 + len(p) <= most:
            out[-1] += "\n" + p
        else:
            out.append(p)
    return out


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2].lower() if isinstance(e.tag, str) else ""


def _words(e: ET.Element) -> str:
    return " ".join("".join(e.itertext()).split())


def xml_sections(xml: str) -> list[tuple[str, str, str]]:
    """(category, name, text) of an article in JATS or TEI; nothing if it cannot be read.

    A section takes the class of its title, or its ancestors' where its own says
    nothing; a section inside another is a section of its own.
    """
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return []
    out: list[tuple[str, str, list[str]]] = []

    def walk(e: ET.Element, category: str, name: str, body: list[str] | None) -> None:
        tag = _tag(e)
        if tag in ("sec", "div", "abstract", "ref-list"):
            title = next((_words(c) for c in e if _tag(c) in ("title", "head")), "")
            fixed = {"abstract": "abstract", "ref-list": "references"}.get(tag)
            found = heading(title)
            category = fixed or (found[0] if found else category)
            body = []
            out.append((category, title or name or category, body))
        if tag in ("p", "ref") and body is not None:
            if text := _words(e):
                body.append(text)
            return
        for child in e:
            walk(child, category, name, body)

    walk(root, "other", "", None)
    return [(c, n, "\n".join(b)) for c, n, b in out if b]


def bears_methods(chunks: DataFrame, key: str) -> DataFrame:
    """Keys of articles with three chunks or more, one of them of methods."""
    return chunks.groupBy(key).agg(F.count("*").alias("n"), F.max((F.col("category") == "method").cast("int")).alias("m")).filter("n >= 3 and m = 1").select(key)


def xml_chunks(df: DataFrame, key: str = "id", xml: str = "xml") -> DataFrame:
    """(key, chunk_index, category, section, chunk_text) of XML articles, packed by paragraph."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, x in zip(frame[key], frame[xml]):
                parts = [(c, n, p) for c, n, t in xml_sections(x or "") for p in pack_paragraphs(t)]
                rows += [(k, i, *p) for i, p in enumerate(parts)]
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "category", "section", "chunk_text"])

    return df.select(key, xml).mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, chunk_index int, category string, section string, chunk_text string")


def page_metadata(html: Column | str) -> Column:
    """struct(title, description, author, published) of a page's head, nulls where it has none."""
    c = F.col(html) if isinstance(html, str) else html

    def meta(*names: str) -> list[Column]:
        first = r"""(?is)<meta\b[^>]*\b(?:name|property)\s*=\s*["']?{0}["'\s][^>]*?\bcontent\s*=\s*["']([^"']*)["']"""
        turned = r"""(?is)<meta\b[^>]*\bcontent\s*=\s*["']([^"']*)["'][^>]*\b(?:name|property)\s*=\s*["']?{0}["'\s/>]"""
        return [missing(F.regexp_extract(c, form.format(re.escape(n)), 1)) for n in names for form in (first, turned)]

    title = missing(F.trim(F.regexp_replace(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")))
    fields = {"title": [*meta("og:title"), title], "description": meta("og:description", "description"), "author": meta("author", "citation_author"), "published": meta("article:published_time", "citation_publication_date", "date")}
    return F.struct(*(F.trim(F.coalesce(*found)).alias(n) for n, found in fields.items()))
