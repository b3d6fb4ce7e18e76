"""A stored vector index: rows laid out by cluster, a validated header, changes without a refit.

Vectors lie in a folder for each cluster; a search ranks the clusters of its queries and
reads the folders of those it probes.  The header (a manifest) holds the
model, the dimension, the number of live rows, and which segments count; readers
that expect another model or dimension are refused, and so is a folder whose rows
are not as many as the header says.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import Versions
from . import search

_ROW = "c int, id long, v array<double>, segment int"
_GONE = "id long, segment int"
#: Segments from which a change rewrites them as one.
MOST_SEGMENTS = 8


class BadHeader(ValueError):
    """The stored index is not the one that its reader expects."""


class VectorStore:
    """Rows (id, vector) by cluster; those with a null or non-finite part take no part, of equal ids one stays."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.versions = Versions(spark, self.path)

    def build(self, vectors: DataFrame, model: str, id_col: str = "vec_id", vector: str = "embedding", k: int = 10, recall: float = 0.95, stamp: str = "") -> VectorStore:
        """Fits clusters on a bounded sample and lays all rows out anew."""
        before, mark = self.versions.current(), self.versions.begin()
        segment = before.get("next", 1)
        rows = _distinct(search.usable(vectors, id_col, vector))
        clusters = search.ivf_fit(rows, k, recall, id_col="id", vector="v")
        dimension = clusters.centres.shape[1]
        self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(clusters.centres)], "c int, v array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centres/segment={segment}")
        header = {"model": model, "dimension": dimension, "clusters": len(clusters.centres), "probes": clusters.probes, "centres": segment, "stamp": stamp}
        count = self._write(rows, clusters.centres, segment, dimension)
        self.versions.forget()
        self.versions.commit(header | {"count": count, "segments": [segment], "next": segment + 1, "gone": False}, mark, before.get("version", 0))
        for old in before.get("segments", []):
            self._drop(old)
        return self

    def open(self, model: str, dimension: int | None = None, check_rows: bool = True) -> VectorStore:
        """This store, if its header and rows are what the reader expects; else ``BadHeader``."""
        now = self.versions.current()
        if not now or not {"model", "dimension", "count", "clusters", "probes", "segments"} <= now.keys():
            raise BadHeader("no header, or not all of it")
        if now["model"] != model or (dimension is not None and now["dimension"] != dimension):
            raise BadHeader(f"stored for {now['model']} with {now['dimension']} dimensions")
        if check_rows:
            found = self.rows().agg(F.count("*"), F.count_if(F.size("v") != now["dimension"]), F.count_if(~F.col("c").between(0, now["clusters"] - 1))).first()
            if tuple(found) != (now["count"], 0, 0):
                raise BadHeader(f"{found[0]} rows for {now['count']}, {found[1]} of another dimension, {found[2]} outside the clusters")
        return self

    def valid(self, model: str, dimension: int | None = None) -> bool:
        try:
            return bool(self.open(model, dimension))
        except BadHeader:
            return False

    def add(self, vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> VectorStore:
        """Adds rows to their nearest clusters, in place of those with the same ids."""
        return self._change(_distinct(search.usable(vectors, id_col, vector)), False)

    def remove(self, ids: DataFrame, id_col: str = "vec_id") -> VectorStore:
        return self._change(ids.select(F.col(id_col).cast("long").alias("id")).filter("id is not null").distinct(), True)

    def _change(self, rows: DataFrame, only_remove: bool) -> VectorStore:
        now = self.versions.current()
        if not now:
            raise BadHeader("there is no index here: build it first")
        mark, segment = self.versions.begin(), now["next"]
        old = self.rows().select("id").join(rows.select("id"), "id", "left_semi")
        old.write.mode("overwrite").parquet(f"{self.path}/gone/segment={segment}")
        lost = self.spark.read.parquet(f"{self.path}/gone/segment={segment}").count()
        more = 0 if only_remove else self._write(rows, self.centres(), segment, now["dimension"])
        content = {k: v for k, v in now.items() if k != "version"}
        self.versions.commit(content | {"count": now["count"] + more - lost, "segments": now["segments"] + [segment], "next": segment + 1, "gone": now["gone"] or lost > 0}, mark, now["version"])
        if len(now["segments"]) >= MOST_SEGMENTS:
            self.compact()
        return self

    def compact(self) -> VectorStore:
        """Rewrites all live rows as one segment; the clusters stay."""
        now = self.versions.current()
        mark, segment = self.versions.begin(), now["next"]
        self._lay(self.rows().select("c", "id", "v"), segment)
        content = {k: v for k, v in now.items() if k != "version"}
        self.versions.commit(content | {"segments": [segment], "next": segment + 1, "gone": False}, mark, now["version"])
        for old in now["segments"]:
            self._drop(old)
        return self

    def _write(self, rows: DataFrame, centres: np.ndarray, segment: int, dimension: int) -> int:
        if dimension and not rows.filter(F.size("v") != dimension).isEmpty():
            raise BadHeader(f"a vector has not {dimension} dimensions")
        self._lay(search.place(rows, centres, 1), segment)
        return self._read("vectors", _ROW, [segment]).count()

    def _lay(self, placed: DataFrame, segment: int) -> None:
        # a salt keeps a cluster that holds much of the table from one task
        salt = F.pmod(F.xxhash64("id"), F.lit(8))
        placed.repartition("c", salt).sortWithinPartitions("c", "id").write.mode("overwrite").partitionBy("c").parquet(f"{self.path}/vectors/segment={segment}")

    def _drop(self, segment: int) -> None:
        for kind in ("vectors", "gone"):
            self.versions.folder.remove(f"{kind}/segment={segment}")

    def _read(self, kind: str, schema: str, segments: list[int]) -> DataFrame:
        paths = [f"{self.path}/{kind}/segment={s}" for s in segments if self.versions.folder.exists(f"{kind}/segment={s}")]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*paths)

    def centres(self) -> np.ndarray:
        now = self.versions.current()
        found = sorted((r["c"], r["v"]) for r in self.spark.read.parquet(f"{self.path}/centres/segment={now['centres']}").collect())  # MOST_CLUSTERS rows
        return np.array([v for _, v in found], np.float64).reshape(len(found), now["dimension"])

    def rows(self, clusters: list[int] | None = None) -> DataFrame:
        """(c, id, v, segment) of the live rows, of some clusters or all."""
        now = self.versions.current()
        found = self._read("vectors", _ROW, now["segments"])
        if clusters is not None:
            found = found.filter(F.col("c").isin(clusters))
        if not now["gone"]:
            return found
        gone = self._read("gone", _GONE, now["segments"]).groupBy("id").agg(F.max("segment").alias("_until"))
        return found.join(gone, "id", "left").filter(F.col("_until").isNull() | (F.col("segment") >= F.col("_until"))).select("c", "id", "v", "segment")

    def search(self, asked: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", probes: int | None = None) -> DataFrame:
        """(query_id, rank, id, similarity) for every row of ``asked``, from the probed clusters' folders."""
        now = self.versions.current()
        asks = search.place(search.usable(asked, id_col, vector).filter(F.size("v") == now["dimension"]), self.centres(), probes or now["probes"])
        probed = sorted(r["c"] for r in asks.select("c").distinct().collect())  # at most a row for each cluster
        return search.search_placed(self.rows(probed).select("c", "id", "v"), asks, k, id_col)


def _distinct(rows: DataFrame) -> DataFrame:
    """One row of each id, the one of the smallest hash."""
    return rows.groupBy("id").agg(F.min_by("v", F.struct(F.xxhash64("v"), "v")).alias("v"))
