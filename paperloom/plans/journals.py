"""Journal cards: what all tables know of a journal, by a fixed precedence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import joins, risk


def cards(asked: DataFrame, metrics: DataFrame, partitions: DataFrame, profiles: DataFrame, journals: DataFrame, publishers: DataFrame, orgs: DataFrame) -> DataFrame:
    """One card for each asked row (id, issn, name, url).

    Local tables first by ISSN, then by name; the cached profile by ISSN or name
    may bring an ISSN and a name with which the local tables are probed again.
    Of the risk layers only URL and exact name count on a card.
    """

    def probe(df: DataFrame, issn: str, name: str, out: str, dim: DataFrame) -> DataFrame:
        d = dim.withColumn("_o", F.struct(*dim.columns))  # of a key's rows the greatest, whatever the order they come in
        return joins.cascade(df, [(N.issn(issn), d, [N.issn("issn"), N.issn("eissn")], "_o"), (N.journal_name(name), d, [N.journal_name("journal_name")], "_o")], out)

    df = probe(probe(asked, "issn", "name", "m1", metrics), "issn", "name", "p1", partitions)
    df = probe(df, "issn", "name", "profile", profiles)
    df = df.withColumn("_issn", F.coalesce("profile.issn", "issn")).withColumn("_name", F.coalesce("profile.journal_name", "name"))
    df = probe(probe(df, "_issn", "_name", "m2", metrics), "_issn", "_name", "p2", partitions)
    at = risk.check(asked.select("id", F.col("name").alias("journal"), F.lit(None).cast("string").alias("publisher"), "url"), journals, publishers, orgs)
    at = at.filter(F.col("layer").isin("url", "exact")).select(F.col("id").alias("_id"), F.col("layer").alias("risk"))
    out = df.join(at, F.col("id") == F.col("_id"), "left")
    return out.select("id", F.coalesce("m1.journal_name", "m2.journal_name", "p1.journal_name", "p2.journal_name", "profile.journal_name", "name").alias("name"), F.coalesce("m1.jif", "m2.jif").alias("jif"), N.quartile(F.coalesce("m1.jif_quartile", "m2.jif_quartile")).alias("quartile"), F.coalesce("p1.major_quartile", "p2.major_quartile").alias("partition"), "risk")
