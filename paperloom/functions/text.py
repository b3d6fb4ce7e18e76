"""Text expressions: tokens, similarity, snippets, classifiers.  All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import _col, journal_name, title_letters

_CJK = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}"

# ---- fixed values: words that say nothing about a journal
JOURNAL_STOP_WORDS = "THE OF AND FOR IN ON A AN TO DE LA LE LES DES DU ET EN UN UNE JOURNAL INTERNATIONAL ADVANCES RESEARCH SCIENCE STUDIES REVIEW REVIEWS ANNALS".split()

# ---- fixed values: forms of heading numbers
HEADING_NUMBERS = (r"^(?:\d+\.)+\d*\.?\s*", r"^\d+[、)]\s*", r"^[一二三四五六七八九十百]+、\s*", r"^[IVXLCM]{2,}\.?\s+", r"^[A-Z]\.\s+")

# ---- fixed values: section headings, first match wins; one pattern for each class
SECTION_HEADINGS = [
    ("abstract", r"^(?:abstract\b|摘\s*要|内容提要)"),
    ("intro", r"^(?:(?:introduction(?:\s+and\s+background)?|background(?:\s+and\s+introduction)?|related\s+works?|prior\s+works?|literature\s+review|related\s+research)\b|引言|前言|背景|研究背景|相关工作|文献综述|研究现状)"),
    ("method", r"^(?:(?:materials\s+and\s+methods|methods|methodology|experimental\s+(?:setup|methods?|section|design)|experiment(?:s|al\s+setup)?|model|approach|proposed\s+(?:method|approach|framework|model)|our\s+(?:method|approach|model|framework)|method\s+overview|algorithm|implementation\s+details?|architecture|design\s+(?:and\s+)?implementation|setup)\b|方法|方法论|材料与方法|实验方法|实验设置|实验设计|模型|算法|实现细节|本文方法|提出的方法|架构|设计与实现)"),
    ("results", r"^(?:(?:results?(?:\s+and\s+(?:discussion|analysis))?|experiments?|evaluation|experimental\s+(?:results?|evaluation)|findings?)\b|结果|实验结果|结果与分析|评估|发现)"),
    ("discussion", r"^(?:(?:discussions?|analysis|discussions?\s+and\s+(?:implications|limitations))\b|讨论|分析|讨论与局限)"),
    ("conclusion", r"^(?:(?:conclusions?|concluding\s+remarks?|final\s+remarks?|summary|future\s+work|future\s+directions?)\b|结论|总结|结束语|展望|未来工作)"),
    ("references", r"^(?:(?:references?|bibliography|works?\s+cited|cited\s+references?)\b|参考文献|引用文献)"),
]


def has_cjk(c: Column | str) -> Column:
    return _col(c).rlike(f"[{_CJK}]")


def tokens(c: Column | str) -> Column:
    """Index tokens: overlapping bigrams of CJK runs, lower-case ASCII words."""
    runs = F.regexp_extract_all(F.lower(_col(c)), F.lit(f"([{_CJK}]+|[a-z0-9]+)"), 1)
    bigrams = lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"^[{_CJK}]"), bigrams(r)).otherwise(F.array(r))))


def token_count(c: Column | str) -> Column:
    """How many index tokens a text has, counted without making them.

    A run of n CJK characters has n - 1 bigrams, and a run of one is a token.
    """
    low = F.lower(F.coalesce(_col(c), F.lit("")))
    times = lambda p: F.regexp_count(low, F.lit(p))
    cjk = times(f"[{_CJK}]") - times(f"[{_CJK}]+") + times(f"(?<![{_CJK}])[{_CJK}](?![{_CJK}])")
    return times("[a-z0-9]+") + F.when(low.rlike(f"[{_CJK}]"), cjk).otherwise(0)


def token_times(c: Column | str, token: str) -> Column:
    """How often one index token occurs in a text."""
    import re

    low = F.lower(F.coalesce(_col(c), F.lit("")))
    if re.fullmatch("[a-z0-9]+", token):
        pattern = f"(?<![a-z0-9]){token}(?![a-z0-9])"
    elif len(token) == 1:
        pattern = f"(?<![{_CJK}]){re.escape(token)}(?![{_CJK}])"
    else:
        pattern = f"(?={re.escape(token)})"  # bigrams overlap
    return F.regexp_count(low, F.lit(pattern))


def any_token_query(c: Column | str, most: int = 64) -> Column:
    """Quoted tokens joined by OR, or null without any."""
    found = F.slice(tokens(c), 1, most)
    return F.when(F.size(found) > 0, F.array_join(F.transform(found, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR "))


def holds_every_word(hay: Column, words: Column | str) -> Column:
    """Every white-space word occurs in the text, whatever the order and case."""
    wanted = F.filter(F.split(F.lower(_col(words)), r"\s+"), lambda w: w != "")
    low = F.lower(F.coalesce(hay, F.lit("")))
    return F.forall(wanted, lambda w: F.contains(low, w))


def bigrams(c: Column | str) -> Column:
    """Distinct character bigrams of a title's letters."""
    letters = F.regexp_extract_all(title_letters(c), F.lit("(.)"), F.lit(1))
    # cut into letters once: they are the one element that the outer function sees
    pairs = lambda own: F.transform(F.sequence(F.lit(1), F.size(own) - 1), lambda i: F.concat(own[i - 1], own[i]))
    none = F.array().cast("array<string>")
    return F.transform(F.array(letters), lambda own: F.when(F.size(own) >= 2, F.array_distinct(pairs(own))).otherwise(none))[0]


def title_similarity(a: Column | str, b: Column | str) -> Column:
    """Dice coefficient over bigram sets; equal letters are 1, too few are 0."""
    x, y = bigrams(a), bigrams(b)
    dice = F.try_divide(2.0 * F.size(F.array_intersect(x, y)), (F.size(x) + F.size(y)).cast("double"))
    same = (title_letters(a) == title_letters(b)) & (title_letters(a) != "")
    return F.when(same, 1.0).otherwise(F.coalesce(dice, F.lit(0.0)))


def keywords(c: Column | str) -> Column:
    """Upper-case words of two letters or more that are no stop words."""
    words = F.split(F.regexp_replace(journal_name(c), r"[^A-Z0-9\s]", " "), r"\s+")
    stop = F.array(*map(F.lit, JOURNAL_STOP_WORDS))
    return F.array_except(F.array_distinct(F.filter(words, lambda w: F.length(w) > 1)), stop)


def keyword_overlap(a: Column, b: Column) -> Column:
    """Shared keywords over the smaller set; 0 if either is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.least(F.size(a), F.size(b)).cast("double")), F.lit(0.0))


def acronym(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")


def strip_markup(c: Column | str) -> Column:
    """Tags and their white space as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(_col(c), "<[^>]*>", " "), r"\s+", " "))


def shorten(c: Column | str, most: int, suffix: str = "...") -> Column:
    c = _col(c)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.left(c, F.lit(most)), F.lit(suffix)))


def highlight_count(c: Column | str, words: list[str]) -> Column:
    """How often any of the words occurs, longest first, whatever the case."""
    import re

    found = "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))
    return F.regexp_count(_col(c), F.lit(f"(?i)(?:{found})"))


def is_garbage(c: Column | str) -> Column:
    """Few letters and digits among the first 1000 characters, or overlong words."""
    head = F.left(_col(c), F.lit(1000))
    share = F.try_divide(F.length(F.regexp_replace(head, r"[^\p{L}\p{N}]", "")), F.length(head))
    words = F.filter(F.split(head, r"\s+"), lambda w: w != "")
    mean = F.try_divide(F.length(F.array_join(words, "")), F.size(words))
    return (F.coalesce(F.length(head), F.lit(0)) == 0) | (share < 0.5) | F.coalesce(mean > 50, F.lit(False))


def section(c: Column | str, longest: int = 60) -> Column:
    """Section class of a heading line, or null for running text."""
    bare = F.trim(_col(c))
    for numbering in HEADING_NUMBERS:
        bare = F.regexp_replace(bare, numbering, "")
    bare = F.trim(bare)
    out = F.lit(None).cast("string")
    for name, pattern in reversed(SECTION_HEADINGS):
        out = F.when(bare.rlike("(?i)" + pattern), name).otherwise(out)
    return F.when((bare != "") & (F.length(bare) <= longest), out)


def identifier_query(c: Column | str) -> Column:
    """struct(kind, value) if the whole text is one DOI, arXiv or PubMed identifier."""
    raw = F.regexp_replace(F.trim(_col(c)), r"[.,;/]+$", "")
    first = lambda *ps: F.coalesce(*(F.nullif(F.regexp_extract(raw, p, 1), F.lit("")) for p in ps))
    d = F.coalesce(first(r"(?i)^https?://(?:dx\.)?doi\.org/(\S+)$", r"(?i)^doi:\s*(\S+)$"), raw)
    a = F.coalesce(first(r"(?i)^https?://arxiv\.org/abs/(\S+)$"), raw)
    p = first(r"(?i)^https?://pubmed\.ncbi\.nlm\.nih\.gov/(\d{1,9})/?$", r"(?i)^pmid:\s*(\d{1,9})$")
    pick = lambda k, v: F.struct(F.lit(k).alias("kind"), v.alias("value"))
    return F.when(d.rlike(r"^10\.\d{4,9}/\S+$"), pick("doi", F.lower(d))).when(a.rlike(r"^\d{4}\.\d{4,5}(?:v\d+)?$"), pick("arxiv", a)).when(p.isNotNull(), pick("pmid", p))


def identifier_type(c: Column | str) -> Column:
    """Kind of an identifier to import; bare digits count as PubMed, the rest as a title."""
    c = _col(c)
    return (
        F.when(c.rlike(r"^10\.\d{4,}/.+"), "doi").when(c.rlike(r"(?i)^https?://doi\.org/"), "doi")
        .when(c.rlike(r"^\d{4}\.\d{4,5}(?:v\d+)?$"), "arxiv").when(c.rlike(r"(?i)^https?://arxiv\.org/"), "arxiv")
        .when(c.rlike(r"^\d{1,8}$"), "pmid").when(F.regexp_replace(c, r"[-\s]", "").rlike(r"^(?:\d{9}[\dXx]|\d{13})$"), "isbn")
        .when(c.rlike(r"(?i)^https?://"), "url").when(c.isNotNull(), "title")
    )


def source_error(c: Column | str) -> Column:
    """Reason class of a bibliographic source's failure."""
    c = F.coalesce(_col(c), F.lit(""))
    return F.when(c.rlike(r"(?i)timed?\s*-?\s*out|request timeout"), "timeout").when(c.rlike(r"(?i)\b429\b|rate\s*limit"), "rate-limited").when(c.rlike(r"\b[45]\d{2}\b"), "http").otherwise("network")


def domain_error(c: Column | str) -> Column:
    """Reason class of a domain source's failure; other order and classes."""
    c = F.coalesce(_col(c), F.lit(""))
    return F.when(c.rlike("(?i)timeout|timed out"), "timeout").when(c.rlike("(?i)429|rate.?limit"), "rate-limited").when(c.rlike("(?i)401|403|unauthor|forbidden|api key"), "auth").when(c.rlike("(?i)network|fetch|ECONN|ENOTFOUND"), "network").otherwise("http")


def token_estimate(c: Column | str) -> Column:
    """Tokens of a text at 4 to 1.6 characters a token, by its share of CJK."""
    c = F.coalesce(_col(c), F.lit(""))
    share = F.coalesce(F.try_divide(F.length(F.regexp_replace(c, f"[^{_CJK}]", "")), F.length(c)), F.lit(0.0))
    return F.ceil(F.length(c) / (4.0 - 2.4 * share)).cast("long")


def one_decimal(x: Column) -> Column:
    """A number of 1 or more with one decimal, rounded by its exact binary value, ties up.

    From 1 on, the fraction of a double is a whole number of 2^-52.
    """
    whole = F.floor(x)
    part = ((x - whole) * F.lit(2.0**52)).cast("long")
    tenths = whole * 10 + F.shiftright(part * 20 + F.lit(2**52).cast("long"), 53)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"))


def short_number(c: Column | str) -> Column:
    """1.5M, 25.0k, or the number."""
    c = _col(c)
    return F.when(c >= 1_000_000, F.concat(one_decimal(c / 1e6), F.lit("M"))).when(c >= 1000, F.concat(one_decimal(c / 1e3), F.lit("k"))).otherwise(c.cast("long").cast("string"))


def short_bytes(c: Column | str) -> Column:
    """Sizes in units of 1024: 1.5 GB, 2.0 MB, 3.1 KB, or bytes."""
    c = _col(c)
    out = None
    for unit, size in (("GB", 2**30), ("MB", 2**20), ("KB", 2**10)):
        shown = F.concat(one_decimal(c / float(size)), F.lit(f" {unit}"))
        out = F.when(c >= size, shown) if out is None else out.when(c >= size, shown)
    return out.otherwise(F.concat(c.cast("long").cast("string"), F.lit(" B")))


# ---- fixed values of the calibration: smoothing and its bounds
EMA_ALPHA, EMA_LEAST, EMA_MOST = 0.3, 1.0, 6.0


def calibrated_ratio(observed: Column | str, start: float = 4.0) -> Column:
    """Characters a token after a list of observations in order, exponentially smoothed.

    Null and non-positive observations change nothing.
    """
    step = lambda s, x: F.when(x > 0, F.greatest(F.lit(EMA_LEAST), F.least(F.lit(EMA_MOST), s * (1 - EMA_ALPHA) + x * EMA_ALPHA))).otherwise(s)
    return F.aggregate(_col(observed), F.lit(start), lambda s, x: step(s, x.cast("double")))


def fold_query(c: Column | str) -> Column:
    """Hyphens and underscores between letters or digits as spaces; identifiers untouched."""
    c = F.trim(_col(c))
    folded = F.regexp_replace(c, r"(?<=[\p{L}\p{N}])[-_](?=[\p{L}\p{N}])", " ")
    return F.when(identifier_query(c).isNotNull(), c).otherwise(folded)


def inverted_text(c: Column | str) -> Column:
    """A text's inverted form, a map of each word between blanks to its positions; null without a text.

    Words are sorted once and cut where the next one differs, all in the row of the text.
    """
    words = F.array_sort(F.transform(F.split(_col(c), " ", -1), lambda w, i: F.struct(w.alias("word"), i.alias("at"))))

    def entries(own: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: (i == 0) | (own[i]["word"] != own[F.greatest(i - 1, F.lit(0))]["word"]))
        ends = lambda s: F.concat(F.slice(s, 2, F.size(s)), F.array(F.size(own)))
        cut = lambda s, e: F.struct(own[s]["word"].alias("word"), F.transform(F.slice(own, s + 1, e - s), lambda x: x["at"]).alias("places"))
        return F.transform(F.array(starts), lambda s: F.zip_with(s, ends(s), cut))[0]

    # sorted and cut once: they are the one element that the outer functions see
    return F.map_from_entries(F.transform(F.array(words), entries)[0])


def abstract_text(index: Column | str) -> Column:
    """Text of an inverted abstract, a map of word to positions."""
    flat = F.flatten(F.transform(F.map_entries(_col(index)), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.array_sort(flat), lambda x: x["word"]), " ")
