"""Normal forms of identifiers and names; every key comparison goes through one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def missing(c: Column | str) -> Column:
    """Null for null, empty and blank text: the three ways to say "missing"."""
    c = _col(c)
    return F.when(F.trim(c) != "", c)


def issn(c: Column | str) -> Column:
    """Without hyphens and white space, upper case."""
    return missing(F.upper(F.regexp_replace(_col(c), r"[-\s]", "")))


def journal_name(c: Column | str) -> Column:
    """Trimmed, white space collapsed, upper case."""
    return missing(F.upper(F.trim(F.regexp_replace(_col(c), r"\s+", " "))))


def doi(c: Column | str) -> Column:
    """Bare lower-case DOI from a URL with or without scheme, a doi: form or itself."""
    bare = F.regexp_replace(F.trim(_col(c)), r"(?i)^(?:https?://)?(?:dx\.)?doi\.org/", "")
    return missing(F.lower(F.trim(F.regexp_replace(bare, r"(?i)^doi:\s*", ""))))


def doi_strict(c: Column | str) -> Column:
    """The variant that only strips URLs with a scheme, and keeps the case."""
    bare = F.regexp_replace(F.trim(_col(c)), r"(?i)^https?://(?:dx\.)?doi\.org/", "")
    return missing(F.trim(F.regexp_replace(bare, r"(?i)^doi:\s*", "")))


def title_letters(c: Column | str) -> Column:
    """Lower-case ASCII letters, digits and CJK ideographs alone, for similarity."""
    return F.regexp_replace(F.lower(_col(c)), r"[^a-z0-9\x{4e00}-\x{9fff}]+", "")


def title_key(c: Column | str, least: int = 10) -> Column:
    """ASCII letters and digits; null when too short to tell titles apart."""
    key = F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "")
    return F.when(F.length(key) >= least, key)


def phrase(c: Column | str) -> Column:
    """Lower case with every run of other than letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(_col(c)), r"[^\p{L}\p{N}]+", " "))


def host(c: Column | str) -> Column:
    """Lower-case host of a URL without www.; null for what is no http URL."""
    part = F.regexp_extract(F.lower(F.trim(_col(c))), r"^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return missing(F.regexp_replace(part, r"^www\.", ""))


def year(c: Column | str) -> Column:
    """The first run of four digits as a number."""
    return F.regexp_extract(_col(c).cast("string"), r"(\d{4})", 1).try_cast("int")


def licence(c: Column | str) -> Column:
    """Licence class; the order of the tests matters."""
    x = F.lower(F.regexp_replace(F.trim(_col(c)), r"[\s_]+", "-"))
    out = F.when(x.rlike(r"cc-?0|public-?domain|zero"), "cc0")
    for name in ("by-nc-sa", "by-nc", "by-sa", "by"):
        out = out.when(x.contains(name), name)
    return F.when(missing(c).isNotNull(), out.otherwise("other"))


def patent(c: Column | str) -> Column:
    """country-number[-kind] in lower case, or null under four digits."""
    s = F.upper(F.trim(_col(c)))
    s = F.regexp_replace(s, r"^(?:(?:PATENT|PAT\.|NUMBER|NO\.?)\s*)+", "")
    s = F.regexp_replace(F.regexp_replace(s, r"^特許第\s*", ""), r"\s*号$", "")
    shape = r"^([A-Z]{2})[\s\-/]*(\d[\d,\s/]*?\d)[\s\-/]*([A-Z]\d?)?\s*$"
    digits = F.regexp_replace(F.regexp_extract(s, shape, 2), r"[,\s/]", "")
    kind = missing(F.regexp_extract(s, shape, 3))
    return F.when(F.length(digits) >= 4, F.lower(F.concat_ws("-", F.regexp_extract(s, shape, 1), digits, kind)))


def quartile(c: Column | str) -> Column:
    """Q1 to Q4, else null."""
    c = F.upper(F.trim(_col(c)))
    return F.when(c.rlike("^Q[1-4]$"), c)


def stage_key(doi_col: Column | str, url: Column | str) -> Column:
    """One key across stages: the DOI, else host and path, else the URL; null never merges."""
    u = F.lower(F.trim(_col(url)))
    place = F.regexp_replace(F.regexp_extract(u, r"^https?://[^/?#]+([^?#]*)", 1), "/+$", "")
    return F.coalesce(F.concat(F.lit("doi:"), doi(doi_col)), F.concat(F.lit("url:"), host(url), place), missing(u))
