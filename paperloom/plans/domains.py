"""Domain search: sources of a domain, gated, merged, filtered, enriched, marked.

Every search returns rows and a status table: what failed, what was skipped and
why travels with the results, so "failed" is never read as "empty".
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import scoring as C
from ..operators import dedup, filters, joins
from ..sources.recorded import CONNECTORS, result_rows


@dataclass(frozen=True)
class Domain:
    """A plug-in: which sources, how rows are enriched, which extras are kept."""

    name: str
    sources: tuple[str, ...]
    enrich: Callable[[DataFrame], DataFrame] = lambda df: df
    extras: dict[str, str] = field(default_factory=dict)


def _metric(name: str):
    return F.try_element_at("metrics", F.lit(name))


# ---- fixed values: what a patent's kind code says, and what a source's items are called
PATENT_STATUS = {"b1": "granted", "b2": "granted", "a1": "published", "a2": "published", "a9": "published", "u1": "utility", "p1": "provisional"}
DATA_TYPES = {
    "geo": "Gene Expression Data", "pubchem": "Chemical Compound", "pangaea": "Geoscience Data", "icpsr": "Social Science Data",
    "inspire": "Physics Literature", "ads": "Physics Literature", "zbmath": "Mathematics Literature", "repec": "Economics Literature",
}


def _table(values: dict[str, str], key):
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key)


def patent_status(df: DataFrame) -> DataFrame:
    """Legal status by kind code; a patent number without one has none."""
    kind = F.try_element_at(F.split("dedup_key", "-"), F.lit(3))
    return df.withColumn("status", F.when(kind.isNotNull(), F.coalesce(_table(PATENT_STATUS, kind), F.lit("unknown"))))


def researcher(df: DataFrame) -> DataFrame:
    where = F.concat(_metric("institution"), F.coalesce(F.concat(F.lit(" ("), N.missing(_metric("country")), F.lit(")")), F.lit("")))
    return df.withColumn("status", C.researcher_level(_metric("works").try_cast("long"))).withColumn("place", where)


def grant(df: DataFrame) -> DataFrame:
    """Amount, term and status; "inactive" is tested before "active"."""
    s = F.lower(N.missing(_metric("status")))
    status = F.when(s.rlike("inactive|closed|ended|completed|finished"), "completed").when(s.rlike("terminated|cancel|suspend"), "terminated").when(s.rlike("active|ongoing|in.progress|open|signed"), "active").when(s.isNotNull(), "unknown")
    amount = _metric("amount").try_cast("double")
    term = F.concat(_metric("start"), F.lit(" ~ "), _metric("end"))  # null unless both are known
    return df.withColumns({"status": status, "amount": F.when(amount > 0, F.concat(F.lit("$"), F.format_number(amount, 0))), "term": term})


def trial(df: DataFrame) -> DataFrame:
    """Phases joined by a slash, and the class of the status."""
    s = F.lower(N.missing(_metric("status")))
    status = F.when(s.contains("recruit"), "recruiting").when(s.contains("complet"), "completed").when(s.contains("terminat"), "terminated").when(s.contains("withdraw"), "withdrawn").when(s.isNotNull(), "unknown")
    return df.withColumn("status", status).withColumn("phase", F.replace(_metric("phases"), F.lit(","), F.lit("/")))


def data_type(df: DataFrame) -> DataFrame:
    """What a source's items are called."""
    return df.withColumn("data_type", _table(DATA_TYPES, F.col("source")))


def preprint(df: DataFrame) -> DataFrame:
    return df.withColumn("document_type", F.lit("preprint")).withColumn("peer_reviewed", F.lit(False))


def overlay_registry(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """``rows`` with publisher, creators and licence of a recorded DOI registry, where it has them.

    ``registry`` has doi, publisher, creators and licenses (lists of text); the
    first licence that begins with "cc-" counts.
    """
    licence = F.try_element_at(F.filter("licenses", lambda x: x.startswith("cc-")), F.lit(1))
    known = registry.select(N.doi("doi").alias("_doi"), F.filter(F.array(*(F.struct(F.lit(n).alias("key"), N.missing(v).alias("value")) for n, v in (("publisher", F.col("publisher")), ("creators", F.array_join("creators", "; ")), ("license", licence)))), lambda e: e["value"].isNotNull()).alias("_new")).filter("_doi is not null").groupBy("_doi").agg(F.first("_new").alias("_new"))
    new = F.coalesce(F.map_from_entries("_new"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter("metrics", lambda k, _: ~F.map_contains_key(new, k))
    return rows.join(known, F.col("doi") == F.col("_doi"), "left").withColumn("metrics", F.map_concat(kept, new)).drop("_doi", "_new")


# ---- fixed values: labels of what a saved item keeps, and the column or metric that holds it
EXTRAS = {
    "patent": {"Patent Number": "dedup_key", "Assignees": "applicants", "Inventors": "inventors", "IPC/CPC": "classes", "Application Date": "applied", "Legal Status": "status", "Citations": "citations"},
    "dataset": {"DOI": "doi", "Creators": "creators", "License": "license", "Publisher": "publisher", "Task Tags": "tags", "Downloads": "downloads", "Likes": "likes"},
    "researcher": {"ORCID": "orcid", "H-Index": "hIndex", "Citations": "citations", "Works": "works"},
    "grant": {"Funder": "funder", "Amount": "amount", "Period": "term", "Status": "status"},
    "clinicaltrial": {"Phase": "phase", "Status": "status", "Sponsor": "sponsor"},
}


def extra_fields(rows: DataFrame, domain: str) -> DataFrame:
    """``rows`` with ``extra``, a map of label to value without those that are missing."""
    value = lambda name: N.missing(F.col(name).cast("string") if name in rows.columns else _metric(name))
    pairs = [x for label, name in DOMAINS[domain].extras.items() for x in (F.lit(label), value(name))]
    made = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    return rows.withColumn("extra", made)


_ENRICH = {"patent": patent_status, "researcher": researcher, "grant": grant, "clinicaltrial": trial, "preprint": preprint} | {d: data_type for d in ("bio", "chemistry", "geoscience", "social-science", "physics", "mathematics", "economics")}
DOMAINS: dict[str, Domain] = {d: Domain(d, tuple(c.source for c in CONNECTORS.values() if c.domain == d), _ENRICH.get(d, lambda df: df), EXTRAS.get(d, {})) for d in dict.fromkeys(c.domain for c in CONNECTORS.values())}


def search(
    spark: SparkSession,
    payloads: DataFrame,
    domain: str,
    most: int,
    wanted: dict | None = None,
    chosen: Sequence[str] = (),
    failures: dict[str, str] | None = None,
    keys: Sequence[str] = (),
    library: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(rows, status) of one domain search over recorded payloads.

    Order: narrow, capability and key gates, quota by source, merge by key,
    year and licence filters, enrich, mark, cap.
    """
    d, wanted, failures = DOMAINS[domain], wanted or {}, failures or {}
    active = [k for k in ("license", "oaType", "taskTags", "country") if wanted.get(k)]
    status, used = [], []
    for s in d.sources:
        c = CONNECTORS[s]
        if chosen and s not in chosen:
            continue
        if set(active) - set(c.filters):
            status.append((s, "skipped", "filter"))
        elif c.needs_key and s not in keys:
            status.append((s, "skipped", "key"))
        elif s in failures:
            status.append((s, "failed", failures[s]))
        else:
            used.append(s)
            status.append((s, "ok", None))
    said = spark.createDataFrame(status, "source string, state string, reason string")
    from ..functions.text import domain_error

    said = said.withColumn("reason", F.when(F.col("state") == "failed", domain_error("reason")).otherwise(F.col("reason")))
    if not used:
        return result_rows(payloads.filter("false"), d.sources[:1] or ("zenodo",)).withColumn("sources", F.array().cast("array<string>")), said
    rows = filters.per_group(result_rows(payloads, used), "source", ["ord"], ceil(most / len(used)))
    rank = F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(used) for x in (s, i)]), F.col("source"))
    rows = rows.withColumn("ord", F.col("ord") * len(used) + rank)
    rows = dedup.first_whole(rows, F.col("dedup_key"))
    rows = filters.year_window(rows, wanted.get("year"))
    if wanted.get("license"):
        rows = rows.filter(N.licence(_metric("license")) == N.licence(F.lit(wanted["license"])))
    if wanted.get("oaType"):
        rows = rows.filter(F.lower(_metric("oaType")) == wanted["oaType"].lower())
    if wanted.get("country"):
        rows = rows.filter(F.lower(_metric("country")).contains(wanted["country"].lower()))
    if wanted.get("taskTags"):
        rows = filters.any_tag(rows.withColumn("tags", F.split(F.coalesce(_metric("tags"), F.lit("")), ",")), wanted["taskTags"])
    rows = extra_fields(d.enrich(rows), domain)
    if library is not None:
        rows = joins.mark(rows, F.col("dedup_key"), library, F.col("dedup_key"))
    return rows.orderBy("ord").limit(most), said
