"""Embeddings and vector indexes behind one interface."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from . import joins, search


class Provider(Protocol):
    """Gives texts their vectors; a live model is one, recorded vectors are another."""

    model: str

    def embed(self, texts: DataFrame) -> DataFrame:
        """(id, text) to (id, embedding)."""


@dataclass(frozen=True)
class Recorded:
    """Vectors that were computed before, by id."""

    model: str
    vectors: DataFrame

    def embed(self, texts: DataFrame) -> DataFrame:
        return texts.select("id").join(self.vectors, "id")


@dataclass(frozen=True)
class Hashing:
    """Signed feature hashing of index tokens: deterministic, no model.

    A token's bucket and sign come from its MD5; counts are summed by (id, bucket)
    before the vector is laid out.  A text without tokens is the zero vector.
    """

    model: str = "hashing"
    dims: int = 64

    def embed(self, texts: DataFrame) -> DataFrame:
        found = texts.select("id", F.explode(tokens("text")).alias("t"))
        code = F.conv(F.left(F.md5("t"), F.lit(8)), 16, 10).cast("long")
        signed = found.select("id", F.pmod(code, F.lit(self.dims)).cast("int").alias("b"), F.when(F.shiftright(code, 31) == 1, -1).otherwise(1).alias("s"))
        sums = signed.groupBy("id", "b").agg(F.sum("s").cast("double").alias("x"))
        packed = sums.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("b", "x"))).alias("m"))
        dense = F.transform(F.sequence(F.lit(0), F.lit(self.dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
        out = texts.select("id").join(packed, "id", "left")
        return out.select("id", F.when(F.col("m").isNull(), F.array_repeat(F.lit(0.0), self.dims)).otherwise(dense).alias("embedding"))


@dataclass(frozen=True)
class Index:
    """Vectors (id, embedding) that can be added to, taken from and searched.

    Every change is a new index over a new DataFrame; writing it is the caller's.
    """

    vectors: DataFrame

    def add(self, rows: DataFrame) -> Index:
        """With the rows' ids in place of equal ones; of rows of one id one stays."""
        new = rows.select("id", "embedding").withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("embedding")))).filter("_n = 1").drop("_n")
        return replace(self, vectors=self.remove(new).vectors.unionByName(new))

    def remove(self, ids: DataFrame) -> Index:
        return replace(self, vectors=self.vectors.join(ids.select("id").distinct(), "id", "left_anti").select("id", "embedding"))

    def search(self, query: list[float], k: int) -> DataFrame:
        """(id, similarity) of the k nearest rows."""
        return search.nearest(self.vectors, query, k, "id", "embedding")


@dataclass(frozen=True)
class InvertedFile(Index):
    """An index that looks only into the clusters nearest to each query."""

    clusters: search.Clusters | None = None

    def fitted(self) -> InvertedFile:
        return replace(self, clusters=search.ivf_fit(self.vectors, id_col="id"))

    def search_all(self, asked: DataFrame, k: int) -> DataFrame:
        """(query_id, rank, id, similarity) for every row of ``asked``."""
        own = self if self.clusters is not None else self.fitted()
        return search.ivf_search(own.vectors, own.clusters, asked, k, "id")


def refresh(index: Index, stored: DataFrame, now: DataFrame, provider: Provider) -> Index:
    """The index after a library changed from ``stored`` to ``now`` (both id, text).

    Vectors of unchanged texts stay, new and changed texts are embedded, and what
    is no longer there goes.
    """
    gone = joins.orphans(stored.select("id"), now, "id")
    return index.remove(gone).add(provider.embed(joins.stale(stored, now, "id", "text")))
