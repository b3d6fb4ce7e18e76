"""Connectors over recorded payloads.

A connector names a source, the payload fields that hold each result column, how
its key is made and which filters it can push down.  Payloads are stored as
JSON lines, one response item a line, in ``<root>/<source>/``; reading is a
plain JSON scan with a path filter on the source, and mapping is one select.
Live HTTP is out of scope: a run reads what was recorded.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N

RESULT = "source string, ord long, source_id string, title string, authors string, url string, snippet string, year string, doi string, dedup_key string, metrics map<string,string>"


def at(path: str) -> Callable[[Column], Column]:
    """A JSON path of the payload as text."""
    return lambda p: F.get_json_object(p, f"$.{path}")


def first_of(*paths: str) -> Callable[[Column], Column]:
    return lambda p: F.coalesce(*(N.missing(F.get_json_object(p, f"$.{x}")) for x in paths))


def listed(*paths: str, sep: str = "; ") -> Callable[[Column], Column]:
    """A JSON list of the payload as one text, or the text that stands in its place."""

    def one(p: Column, path: str) -> Column:
        raw = F.get_json_object(p, f"$.{path}")
        if "[*]" in path:  # of one match Spark gives the element in its quotes
            raw = F.when(raw.startswith('"'), F.get_json_object(F.concat(F.lit("["), raw, F.lit("]")), "$[0]")).otherwise(raw)
        return F.when(raw.startswith("["), F.array_join(F.from_json(raw, "array<string>"), sep)).otherwise(raw)

    return lambda p: F.coalesce(*(N.missing(one(p, x)) for x in paths))


def size_of(path: str) -> Callable[[Column], Column]:
    """How many elements a JSON list of the payload has."""
    return lambda p: F.nullif(F.coalesce(F.json_array_length(F.get_json_object(p, f"$.{path}")), F.lit(0)), F.lit(0)).cast("string")


@dataclass(frozen=True)
class Connector:
    """How one source's payload becomes result rows."""

    source: str
    domain: str
    source_id: Callable[[Column], Column]
    title: Callable[[Column], Column]
    url: Callable[[Column], Column] = at("url")
    snippet: Callable[[Column], Column] = first_of("abstract", "description", "snippet")
    authors: Callable[[Column], Column] = first_of("authors", "creators")
    year: Callable[[Column], Column] = first_of("year", "published", "date")
    doi: Callable[[Column], Column] = first_of("doi", "DOI")
    key: str = "doi"  # doi, doi_or_id, id, patent
    prefix: str = ""
    filters: tuple[str, ...] = ()
    dialect: str = "plain"
    needs_key: bool = False
    metrics: dict[str, Callable[[Column], Column]] = field(default_factory=dict)

    def rows(self, payloads: DataFrame) -> DataFrame:
        p = F.col("payload")
        doi, sid = N.doi(self.doi(p)), N.missing(self.source_id(p))
        own = F.concat(F.lit(f"{self.prefix or self.source}:"), sid)
        key = {"doi": doi, "doi_or_id": F.coalesce(doi, own), "id": own, "patent": N.patent(sid)}[self.key]
        pairs = [x for n, f in self.metrics.items() for x in (F.lit(n), f(p))]
        metrics = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
        return payloads.select(F.lit(self.source).alias("source"), F.col("ord").cast("long").alias("ord"), sid.alias("source_id"), N.missing(self.title(p)).alias("title"), N.missing(self.authors(p)).alias("authors"), N.missing(self.url(p)).alias("url"), N.missing(self.snippet(p)).alias("snippet"), N.year(self.year(p)).cast("string").alias("year"), doi.alias("doi"), key.alias("dedup_key"), metrics.alias("metrics"))


def _shaped(**paths: str) -> dict[str, Callable[[Column], Column]]:
    """Result columns read from a service's own payload: a column's paths stand in order, parted by spaces."""
    lists = {"authors"}
    return {name: (listed if name in lists else first_of)(*where.split()) for name, where in paths.items()}


# ---- fixed values: where the services' public payloads hold each column; lists are joined
SHAPES: dict[str, dict[str, Callable[[Column], Column]]] = {
    "openalex": _shaped(source_id="id", title="title display_name", authors="authorships[*].author.display_name", url="primary_location.landing_page_url id", snippet="abstract", year="publication_year", doi="doi"),
    "crossref": _shaped(source_id="DOI", title="title[0]", authors="author[*].family", url="URL", snippet="abstract", year="issued.date-parts[0][0] created.date-time", doi="DOI"),
    "pubmed": _shaped(source_id="uid", title="title", authors="authors[*].name", url="url", snippet="abstract", year="pubdate", doi="doi elocationid"),
    "europe-pmc": _shaped(source_id="id", title="title", authors="authorString", url="fullTextUrlList.fullTextUrl[0].url", snippet="abstractText", year="pubYear", doi="doi"),
    "semantic-scholar": _shaped(source_id="paperId", title="title", authors="authors[*].name", url="url", snippet="abstract tldr.text", year="year publicationDate", doi="externalIds.DOI"),
    "core": _shaped(source_id="id", title="title", authors="authors[*].name", url="downloadUrl", snippet="abstract", year="yearPublished", doi="doi"),
    "doaj": _shaped(source_id="id", title="bibjson.title", authors="bibjson.author[*].name", url="bibjson.link[0].url", snippet="bibjson.abstract", year="bibjson.year", doi="bibjson.identifier[0].id"),
    "hal": _shaped(source_id="docid", title="title_s[0]", authors="authFullName_s", url="uri_s", snippet="abstract_s[0]", year="producedDateY_i", doi="doiId_s"),
    "biorxiv": _shaped(source_id="doi", title="title", authors="authors", url="url", snippet="abstract", year="date", doi="doi"),
    "medrxiv": _shaped(source_id="doi", title="title", authors="authors", url="url", snippet="abstract", year="date", doi="doi"),
    "github": _shaped(source_id="full_name", title="full_name", authors="owner.login", url="html_url", snippet="description", year="created_at", doi="doi"),
    "dimensions": _shaped(source_id="id", title="title", authors="authors[*].last_name", url="linkout", snippet="abstract", year="year", doi="doi"),
    "zenodo": _shaped(source_id="id", title="metadata.title title", authors="metadata.creators[*].name creators", url="links.html links.self_html", snippet="metadata.description", year="metadata.publication_date year", doi="doi metadata.doi"),
    "figshare": _shaped(source_id="id", title="title", authors="authors[*].full_name creators", url="url_public_html", snippet="description", year="published_date year", doi="doi"),
    "dryad": _shaped(source_id="id identifier", title="title", authors="authors[*].lastName creators", url="sharingLink", snippet="abstract", year="publicationDate year", doi="doi identifier"),
    "dataverse": _shaped(source_id="global_id id", title="name title", authors="authors", url="url", snippet="description", year="published_at year", doi="doi global_id"),
    "datacite-search": _shaped(source_id="id", title="attributes.titles[0].title", authors="attributes.creators[*].name", url="attributes.url", snippet="attributes.descriptions[0].description", year="attributes.publicationYear", doi="attributes.doi"),
    "osf": _shaped(source_id="id", title="attributes.title title", authors="creators", url="links.html", snippet="attributes.description", year="attributes.date_created year", doi="doi"),
    "huggingface": _shaped(source_id="id", title="id", authors="author", url="url", snippet="description", year="lastModified", doi="doi"),
    "kaggle": _shaped(source_id="ref", title="title", authors="ownerName", url="url", snippet="subtitle", year="lastUpdated", doi="doi"),
    "openml": _shaped(source_id="did id", title="name", authors="creator", url="url", snippet="description", year="upload_date", doi="doi"),
    "gbif": _shaped(source_id="key", title="title", authors="publishingOrganizationTitle", url="homepage", snippet="description", year="pubDate created", doi="doi"),
    "geo": _shaped(source_id="accession", title="title", authors="contributor", url="url", snippet="summary", year="pdat", doi="doi"),
    "pubchem": _shaped(source_id="CID id", title="Title title", authors="authors", url="url", snippet="IUPACName", year="year", doi="doi"),
    "nih": _shaped(source_id="appl_id project_num id", title="project_title title", authors="contact_pi_name", url="project_detail_url", snippet="abstract_text", year="fiscal_year", doi="doi"),
    "nsf": _shaped(source_id="id", title="title", authors="pdPIName", url="url", snippet="abstractText", year="startDate date", doi="doi"),
    "cordis": _shaped(source_id="id rcn", title="title", authors="coordinator", url="url", snippet="objective teaser", year="startDate", doi="grantDoi"),
    "clinicaltrials": _shaped(source_id="protocolSection.identificationModule.nctId id", title="protocolSection.identificationModule.briefTitle title", authors="protocolSection.sponsorCollaboratorsModule.leadSponsor.name", url="url", snippet="protocolSection.descriptionModule.briefSummary", year="protocolSection.statusModule.startDateStruct.date", doi="doi"),
    "openalex-author": _shaped(source_id="id", title="display_name", authors="display_name", url="id", snippet="last_known_institutions[0].display_name", year="year", doi="doi"),
    "openalex-institution": _shaped(source_id="id", title="display_name", authors="display_name", url="homepage_url", snippet="geo.city", year="year", doi="doi"),
    "orcid": _shaped(source_id="orcid-identifier.path orcid-id", title="credit-name", authors="family-names", url="orcid-identifier.uri", snippet="institution-name[0]", year="year", doi="doi"),
    "semantic-scholar-author": _shaped(source_id="authorId", title="name", authors="name", url="url", snippet="affiliations[0]", year="year", doi="doi"),
    "google-patents": _shaped(source_id="publication_number id", title="title", authors="inventor", url="pdf", snippet="snippet", year="publication_date", doi="doi"),
    "uspto": _shaped(source_id="patent_id patentNumber id", title="patent_title title", authors="inventors[*].inventor_name_last", url="url", snippet="patent_abstract", year="patent_date", doi="doi"),
    "unpaywall": _shaped(source_id="doi", title="title", authors="z_authors[*].family", url="best_oa_location.url_for_pdf best_oa_location.url", snippet="journal_name", year="year", doi="doi"),
    "dblp": _shaped(source_id="info.key", title="info.title", authors="info.authors.author[*].text", url="info.ee info.url", snippet="info.venue", year="info.year", doi="info.doi"),
    "inspire": _shaped(source_id="metadata.control_number id", title="metadata.titles[0].title title", authors="metadata.authors[*].full_name", url="links.self", snippet="metadata.abstracts[0].value", year="metadata.earliest_date", doi="metadata.dois[0].value"),
    "ads": _shaped(source_id="bibcode", title="title[0]", authors="author", url="url", snippet="abstract", year="year", doi="doi[0]"),
    "tavily": _shaped(source_id="url", title="title", url="url", snippet="content", year="published_date"),
    "brave": _shaped(source_id="url", title="title", url="url", snippet="description", year="page_age"),
    "exa": _shaped(source_id="url", title="title", authors="author", url="url", snippet="text summary", year="publishedDate"),
    **{s: _shaped(source_id="link", title="title", url="link", snippet="snippet", year="date") for s in ("serper", "serpapi", "google")},
    "bing": _shaped(source_id="url", title="name", url="url", snippet="snippet", year="dateLastCrawled"),
    "searxng": _shaped(source_id="url", title="title", url="url", snippet="content", year="publishedDate"),
    "duckduckgo": _shaped(source_id="FirstURL url", title="Text title", url="FirstURL url", snippet="Text snippet", year="date"),
    "archive": _shaped(source_id="identifier", title="title", authors="creator", url="url", snippet="description", year="date year"),
    "wikipedia": _shaped(source_id="pageid url", title="title", url="fullurl url", snippet="extract snippet", year="timestamp"),
}
# ---- fixed values: what the items of a domain say beside title and year
FIELDS: dict[str, dict[str, Callable[[Column], Column]]] = {
    "literature": {"citations": first_of("cited_by_count", "is-referenced-by-count", "citedByCount", "citationCount", "times_cited", "stargazers_count", "pmcrefcount", "citations"), "openAccess": first_of("open_access.is_oa", "isOpenAccess", "open_access"), "journal": first_of("primary_location.source.display_name", "container-title[0]", "fulljournalname", "journalTitle", "venue", "bibjson.journal.title", "journalTitle_s", "journal.title"), "issn": first_of("primary_location.source.issn_l", "ISSN[0]", "issn", "journalInfo.journal.issn", "bibjson.journal.issns[0]")},
    "dataset": {"license": first_of("metadata.license.id", "license.id", "license.name", "attributes.rightsList[0].rightsIdentifier", "licenseName", "license", "licence", "rights", "rightsIdentifier"), "oaType": first_of("oaType", "metadata.access_right", "access_right", "accessRight"), "tags": listed("taskTags", "tags", "metadata.keywords", "keywords", sep=","), "country": first_of("geographicCoverage", "country"), "publisher": first_of("attributes.publisher", "publisher"), "creators": listed("creators", "metadata.creators[*].name", "attributes.creators[*].name", "authors[*].full_name", "authors[*].name"), "downloads": first_of("stats.downloads", "downloads", "downloadCount"), "likes": first_of("likes", "voteCount")},
    "patent": {"applicants": listed("applicants", "assignees[*].assignee_organization", "assignees", "assignee"), "inventors": listed("inventors[*].inventor_name_last", "inventors", "inventor"), "classes": listed("ipcClasses", "cpc"), "applied": first_of("applicationDate", "filing_date"), "citations": first_of("citationCount", "cited_by", "patent_num_times_cited_by_us_patents"), "familySize": size_of("familyMembers")},
    "grant": {"status": first_of("status", "project_status"), "amount": first_of("award_amount", "fundsObligatedAmt", "ecMaxContribution", "amount"), "start": first_of("startDate", "project_start_date"), "end": first_of("endDate", "project_end_date", "expDate"), "funder": first_of("funder", "agency", "agency_ic_admin.name")},
    "clinicaltrial": {"status": first_of("protocolSection.statusModule.overallStatus", "status", "overallStatus"), "phases": listed("protocolSection.designModule.phases", "phases", sep="/"), "sponsor": first_of("protocolSection.sponsorCollaboratorsModule.leadSponsor.name", "sponsor", "leadSponsor")},
    "researcher": {"works": first_of("works_count", "worksCount", "paperCount"), "citations": first_of("cited_by_count", "citationCount"), "hIndex": first_of("summary_stats.h_index", "hIndex"), "institution": first_of("last_known_institutions[0].display_name", "institution.display_name", "affiliations[0]", "institution-name[0]", "institution", "affiliation"), "country": first_of("last_known_institutions[0].country_code", "institution.country_code", "country_code", "country"), "orcid": first_of("orcid", "orcid-identifier.path")},
    "oa-fulltext": {"oaType": first_of("oa_status"), "license": first_of("best_oa_location.license")},
    "web": {"score": first_of("score", "position")},
}
FIELDS |= {d: FIELDS["dataset"] for d in ("bio", "chemistry", "geoscience", "social-science")}


def _made(source: str, domain: str, general: dict[str, Callable[[Column], Column]], **more) -> Connector:
    """A connector by its service's own shape, else by the general one."""
    return Connector(source, domain, **(general | SHAPES.get(source, {})), metrics=FIELDS.get(domain, {}), **more)


def _biblio(source: str, **more) -> Connector:
    return _made(source, "literature", {"source_id": first_of("id", "doi", "DOI", "pmid"), "title": first_of("title")}, **more)


def _data(source: str, key: str = "id", prefix: str = "", **more) -> Connector:
    general = {"source_id": first_of("id", "code", "accession", "ref", "patentNumber", "name"), "title": first_of("title", "display_name", "name", "label")}
    return _made(source, more.pop("domain", "dataset"), general, key=key, prefix=prefix, **more)


def _web(source: str, **more) -> Connector:
    return _made(source, "web", {"source_id": first_of("url", "link"), "title": first_of("title")}, key="id", prefix="web", **more)


#: Every source by id; names, keys and filters are fixed values of the services.
CONNECTORS: dict[str, Connector] = {
    c.source: c
    for c in [
        *(_biblio(s, filters=("year", "title", "abstract", "openAccess")) for s in ("arxiv", "biorxiv", "crossref", "europe-pmc", "github", "medrxiv", "openalex", "pubmed")),
        *(_biblio(s) for s in ("chinaxiv", "doaj", "hal", "zenodo-records")),
        *(_biblio(s, needs_key=True) for s in ("core", "dimensions", "semantic-scholar")),
        _data("geo", domain="bio", dialect="normalized"),
        _data("pubchem", domain="chemistry"),
        _data("clinicaltrials", domain="clinicaltrial", dialect="normalized"),
        _data("datacite-search", "doi", dialect="normalized"),
        _data("dataverse", "doi_or_id", filters=("license",), dialect="phrase"),
        _data("dryad", "doi_or_id", filters=("license", "oaType")),
        _data("figshare", "doi_or_id", filters=("license", "oaType")),
        _data("zenodo", "doi_or_id", filters=("license", "oaType")),
        _data("huggingface", prefix="hf", filters=("license", "taskTags")),
        _data("kaggle", filters=("license",), needs_key=True),
        _data("openml", filters=("license",)),
        _data("osf", filters=("license", "oaType")),
        _data("uci", filters=("license", "taskTags")),
        *(_data(s, dialect="normalized") for s in ("gbif", "nasa")),
        *(_data(s) for s in ("eurostat", "imf", "oecd", "re3data", "ukds", "who", "worldbank")),
        _data("icpsr", domain="social-science", filters=("license", "country")),
        _data("dblp", domain="dblp"),
        _data("repec", domain="economics"),
        _data("pangaea", domain="geoscience"),
        *(_data(s, domain="grant") for s in ("cordis", "nih")),
        _data("nsf", domain="grant", dialect="phrase"),
        _data("zbmath", domain="mathematics"),
        _data("unpaywall", "doi", domain="oa-fulltext"),
        *(_data(s, "patent", domain="patent") for s in ("google-patents", "uspto", "wipo")),
        _data("epo", "patent", domain="patent", needs_key=True),
        _data("ads", domain="physics", needs_key=True),
        _data("inspire", domain="physics"),
        *(_data(s, domain="preprint") for s in ("chemrxiv", "socarxiv")),
        _data("openalex-author", prefix="oa-author", domain="researcher"),
        _data("openalex-institution", prefix="oa-inst", domain="researcher"),
        _data("orcid", domain="researcher", dialect="normalized"),
        _data("semantic-scholar-author", prefix="s2-author", domain="researcher"),
        _data("oatd", domain="thesis"),
        *(_web(s) for s in ("duckduckgo", "bing-html", "wikipedia", "archive", "searxng")),
        *(_web(s, needs_key=True) for s in ("tavily", "brave", "exa", "serper", "serpapi", "google", "perplexity", "bing")),
    ]
}


def sources(spark: SparkSession) -> DataFrame:
    """The source dimension: what each can filter, and whether it needs a key."""
    rows = [(c.source, c.domain, c.needs_key, list(c.filters), c.dialect) for c in CONNECTORS.values()]
    return spark.createDataFrame(rows, "id string, domain string, needsKey boolean, supportedFilters array<string>, queryDialect string")


def read_payloads(spark: SparkSession, root: str, chosen: Sequence[str]) -> DataFrame:
    """(source, ord, payload) of recorded items; ``root`` is partitioned by source."""
    return spark.read.schema("source string, ord long, payload string").json(root).filter(F.col("source").isin(*chosen))


def result_rows(payloads: DataFrame, chosen: Sequence[str]) -> DataFrame:
    """All chosen sources' rows under one schema, in arrival order within a source."""
    parts = [CONNECTORS[s].rows(payloads.filter(F.col("source") == s)) for s in chosen]
    return reduce(DataFrame.unionByName, parts)
