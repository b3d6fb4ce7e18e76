"""Risk lists: layered match of a journal, its publisher and its URL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import text as X

#: Layers in order, with the confidence of a match.
LAYERS = {"url": 1.0, "exact": 1.0, "abbr": 0.9, "keyword": 0.7}
LEAST_OVERLAP = 0.6


def check(items: DataFrame, journals: DataFrame, publishers: DataFrame, metrics: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, layer, confidence, matched): the best layer that hits, null without one.

    ``items`` has journal, publisher and url; the lists have name and url, the
    journal list also abbr.  Every layer is an equality join: names and hosts by
    normal form, and keyword overlap by shared keywords, counted over an
    inverted list, so no item meets every list entry.
    """
    lists = [(journals.select("name", "url"), 0), (publishers.select("name", "url"), 1), (metrics.select("name", "url"), 2)]
    every = None
    for df, rank in lists:
        part = df.select("name", "url", F.lit(rank).alias("rank"))
        every = part if every is None else every.unionByName(part)
    host = every.select(N.host("url").alias("key"), "name", "rank").filter("key is not null").groupBy("key").agg(F.min_by("name", F.struct("rank", "name")).alias("m_url"))
    exact = lambda rank: every.filter(F.col("rank") == rank).select(N.journal_name("name").alias("key"), "name").filter("key is not null").groupBy("key").agg(F.max("name").alias("m"))
    it = items.select(F.col(id_col).alias("id"), N.journal_name("journal").alias("jn"), N.journal_name("publisher").alias("pn"), N.host("url").alias("h"), X.keywords("journal").alias("kw"))
    out = it.join(host, F.col("h") == F.col("key"), "left").drop("key")
    for name, rank, on in (("m_j", 0, "jn"), ("m_p", 1, "pn"), ("m_mj", 2, "jn"), ("m_mp", 2, "pn")):
        e = exact(rank).select(F.col("key").alias("key"), F.col("m").alias(name))
        out = out.join(e, F.col(on) == F.col("key"), "left").drop("key")
    abbr = journals.select(F.upper(F.trim("abbr")).alias("key"), "name").filter("key <> ''").groupBy("key").agg(F.min("name").alias("m_abbr"))
    out = out.join(abbr, F.when(F.size("kw") > 0, X.acronym(F.col("kw"))) == F.col("key"), "left").drop("key")

    def overlapping(lists: DataFrame, words: str, least: float, fewest: int, name: str) -> DataFrame:
        entry = lists.select("name", words).filter(F.size(words) > 0)
        posted = entry.select("name", F.size(words).alias("n_list"), F.explode(words).alias("w"))
        asked = it.filter(F.size("kw") >= fewest).select("id", F.size("kw").alias("n_item"), F.explode("kw").alias("w"))
        met = asked.join(posted, "w").groupBy("id", "name", "n_item", "n_list").agg(F.count("*").alias("shared"))
        score = F.col("shared") / F.least("n_item", "n_list")
        return met.withColumn("score", score).filter(F.col("score") >= least).groupBy("id").agg(F.max_by("name", F.struct("score", F.col("name"))).alias(name))

    short = journals.filter(N.missing("abbr").isNotNull()).select("name", X.keywords(F.upper("abbr")).alias("words"))
    full = journals.select("name", X.keywords("name").alias("words"))
    out = out.join(overlapping(short, "words", 1.0, 1, "m_short"), "id", "left").join(overlapping(full, "words", LEAST_OVERLAP, 2, "m_kw"), "id", "left")
    exact_name = F.coalesce("m_j", "m_p", "m_mj", "m_mp")
    abbr_name = F.coalesce("m_abbr", "m_short")
    layer = F.when(F.col("m_url").isNotNull(), "url").when(exact_name.isNotNull(), "exact").when(abbr_name.isNotNull(), "abbr").when(F.col("m_kw").isNotNull(), "keyword")
    level = F.create_map(*[F.lit(x) for k, v in LAYERS.items() for x in (k, v)])
    return out.select("id", layer.alias("layer"), F.element_at(level, layer).alias("confidence"), F.coalesce("m_url", exact_name, abbr_name, "m_kw").alias("matched"))


def exact_batch(items: DataFrame, journals: DataFrame, name: str = "journal", order: str = "ord") -> DataFrame:
    """``items`` with the category of an exactly listed journal; of a name's rows the last by ``order`` wins."""
    listed = journals.select(N.journal_name("name").alias("_k"), "category", F.col(order).alias("_o")).filter("_k is not null")
    last = listed.groupBy("_k").agg(F.max_by("category", F.struct("_o", "category")).alias("risk"))
    return items.join(last, N.journal_name(name) == F.col("_k"), "left").drop("_k")
