"""Bundled data sets: tuple-array JSON, quoted CSV, and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.normalize import missing

#: Texts that stand for a missing value in source tables.
NULL_TOKENS = ("N/A", "NA", "-", "—", "")
EXPORT_ROWS = 100_000


def read_tuples(spark: SparkSession, path: str, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows of ``{"year": y, "data": [[...], ...]}`` files with named, typed columns.

    Values are read as text and cast, so mixed types in one position are fine;
    a value that does not fit its type is null.
    """
    raw = spark.read.schema("year int, data array<array<string>>").option("multiLine", True).json(path)
    row = raw.select("year", F.explode("data").alias("t"))
    return row.select("year", *(F.try_element_at("t", F.lit(i + 1)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(columns)))


def read_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """RFC 4180 CSV as text columns; quotes, doubled quotes and line breaks inside them."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


def clean(c: Column | str) -> Column:
    """Null for the tokens that mean missing."""
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.when(~c.isin(*NULL_TOKENS), c)


def number(c: Column | str, kind: str = "double") -> Column:
    """A number out of text such as "1,234" or "<0.1"."""
    return F.regexp_replace(clean(c), r"[,<>\s]", "").try_cast(kind)


def rank_of(c: Column | str) -> Column:
    """1 out of "1/333"."""
    return F.regexp_extract(clean(c), r"^(\d+)\s*/", 1).try_cast("int")


def zone(c: Column | str) -> Column:
    """2 out of "2 区" or "2"."""
    return F.regexp_extract(clean(c), r"^(\d)", 1).try_cast("int")


def grouped(prefixes: Sequence[Sequence[str]], names: Sequence[str]) -> Column:
    """Repeated column groups as one array of structs, without the empty ones."""
    groups = F.array(*(F.struct(*(clean(c).alias(n) for c, n in zip(cols, names))) for cols in prefixes))
    return F.filter(groups, lambda g: g[names[0]].isNotNull())


def read_lists(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Risk lists: journals (with a category), publishers and metrics out of one JSON file."""
    entry = "array<struct<name:string,url:string,abbr:string>>"
    raw = spark.read.schema(f"standalone {entry}, hijacked {entry}, publishers {entry}, metrics {entry}").option("multiLine", True).json(path)

    def rows(key: str) -> DataFrame:
        return raw.select(F.explode(key).alias("e")).select(missing("e.name").alias("name"), missing("e.url").alias("url"), missing("e.abbr").alias("abbr")).filter("name is not null")

    journals = rows("standalone").withColumn("category", F.lit("standalone")).unionByName(rows("hijacked").withColumn("category", F.lit("hijacked")))
    return {"journals": journals, "publishers": rows("publishers").drop("abbr"), "metrics": rows("metrics").drop("abbr")}


def export(df: DataFrame, path: str, kind: str = "csv", most: int = EXPORT_ROWS) -> None:
    """Write at most ``most`` rows as CSV (quoted where needed) or JSON lines."""
    if kind not in ("csv", "json"):
        raise ValueError(f"unknown kind {kind!r}")
    out = df.limit(most).write.mode("overwrite")
    out.option("header", True).option("quote", '"').option("escape", '"').csv(path) if kind == "csv" else out.json(path)


def citation_text(order: Column | str = "ord") -> list[Column]:
    """(position, block) of a numbered reference list; absent fields are skipped."""
    where = F.concat_ws(", ", missing("journal"), missing(F.col("year").cast("string")))
    doi = F.concat(F.lit("doi:"), missing("doi"))
    return [F.col(order).alias("position") if isinstance(order, str) else order.alias("position"), F.concat_ws("\n", missing("title"), missing("authors"), missing(where), doi).alias("block")]


def upsert_lines(extra: Column | str, values: dict[str, Column]) -> Column:
    """Text of "Key: value" lines with the given keys replaced and all others kept."""
    lines = F.filter(F.split(F.coalesce(F.col(extra) if isinstance(extra, str) else extra, F.lit("")), "\n"), lambda x: x != "")
    keys = F.array(*(F.lit(k.lower()) for k in values))
    kept = F.filter(lines, lambda x: ~F.array_contains(keys, F.lower(F.trim(F.substring_index(x, ":", 1)))))
    new = F.filter(F.array(*(F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v.cast("string"))) for k, v in values.items())), lambda x: x.isNotNull())
    return F.array_join(F.concat(new, kept), "\n")


# ---- fixed values: the columns of a result export, in order, by their headers
RESULT_COLUMNS = {"Title": "title", "Authors": "authors", "Year": "year", "Journal": "journal", "DOI": "doi", "Citations": "citations", "Source": "source", "PDF URL": "pdf_url"}


def result_lines(df: DataFrame, order: Sequence[Column], selected: Column | None = None) -> DataFrame:
    """(n, line): a result list as CSV lines in its display order, header first with a byte order mark.

    ``selected`` keeps the chosen rows, if any is chosen.  Ranks come from one
    ordered list: an export is what one reader sees, at most ``EXPORT_ROWS`` rows.
    """
    rows = df
    if selected is not None:
        marked = df.withColumn("_s", F.coalesce(selected, F.lit(False)))
        any_chosen = marked.agg(F.max("_s").alias("_any"))  # one row
        rows = marked.crossJoin(F.broadcast(any_chosen)).filter("_s or not coalesce(_any, false)")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    quoted = lambda x: F.when(x.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
    shown = rows.orderBy(*order).limit(EXPORT_ROWS)
    lines = shown.select(F.row_number().over(Window.orderBy(*order)).alias("n"), F.concat_ws(",", *(quoted(text(c)) for c in RESULT_COLUMNS.values())).alias("line"))
    header = df.sparkSession.range(1).select(F.lit(0).alias("n"), F.lit("\ufeff" + ",".join(RESULT_COLUMNS)).alias("line"))
    return header.unionByName(lines)


def export_results(df: DataFrame, path: str, order: Sequence[Column], selected: Column | None = None) -> None:
    """Write a result list as one CSV file with CRLF line ends."""
    lines = result_lines(df, order, selected).coalesce(1).sortWithinPartitions("n")
    lines.select("line").write.mode("overwrite").option("lineSep", "\r\n").text(path)
