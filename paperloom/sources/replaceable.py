"""Tables whose partitions are replaced as a whole: staged writes, then one manifest that names them.

A change writes the new content of the partitions that it touches into a folder
of its own; the manifest that maps each partition to its folder follows.  Until
then readers see the old rows, and a write that fails leaves them all, those of
other partitions too, as they are never rewritten.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Versions

_PART = "_part"


class ReplaceableTable:
    """Rows of some groups (``keys``), partitioned by a column, or by a hash of the keys.

    A null partition value is a partition of its own.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], part: str | None = None, folders: int = 64):
        self.spark, self.path, self.keys, self.part, self.folders = spark, path.rstrip("/"), list(keys), part, folders
        self.versions = Versions(spark, self.path)

    def _of(self) -> Column:
        if not self.part and not self.keys:
            return F.lit("0")  # one partition, replaced as a whole
        return F.coalesce(F.col(self.part).cast("string"), F.lit("")) if self.part else F.pmod(F.xxhash64(*self.keys), F.lit(self.folders)).cast("string")

    def read(self, parts: Sequence[str] | None = None) -> DataFrame | None:
        """The current rows, of some partitions or all; none before the first write."""
        now = self.versions.current()
        return self._read(now, parts) if now else None

    def _read(self, now: dict, parts: Sequence[str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(now["schema"])
        whole = T.StructType([*schema.fields, T.StructField(_PART, T.StringType())])
        held: dict[str, list[str]] = {}
        for part, folder in now["parts"].items():
            if parts is None or part in parts:
                held.setdefault(folder, []).append(part)
        out = self.spark.createDataFrame([], schema)
        for folder, own in held.items():
            # an empty value is written as the default partition and read back as null
            rows = self.spark.read.schema(whole).parquet(f"{self.path}/data/{folder}")
            out = out.unionByName(rows.filter(F.coalesce(_PART, F.lit("")).isin(own)).drop(_PART))
        return out

    def replace(self, rows: DataFrame, whole: bool = False) -> dict:
        """Puts ``rows`` in place of all rows of their groups, or with ``whole`` of their partitions; the new manifest.

        ``rows`` is read once.  Empty rows change nothing.
        """
        before, mark = self.versions.current(), self.versions.begin()
        staged, folder = f"{self.path}/staged/{mark}", uuid.uuid4().hex
        rows.withColumn(_PART, self._of()).write.parquet(staged)
        new = self.spark.read.schema(T.StructType([*rows.schema.fields, T.StructField(_PART, T.StringType())])).parquet(staged)
        touched = sorted(r[0] for r in new.select(_PART).distinct().collect())  # partitions of the table
        merged = new
        if before and not whole:
            old = self._read(before, touched).withColumn(_PART, self._of())
            same = [F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in self.keys]
            gone = new.select(*(F.col(k).alias(f"_new_{k}") for k in self.keys)).distinct()
            on = same[0]
            for x in same[1:]:
                on = on & x
            merged = old.join(gone, on, "left_anti").unionByName(new, allowMissingColumns=True)
        return self._commit(merged, folder, touched, before, mark)

    def delete(self, groups: DataFrame) -> dict:
        """Removes all rows of some groups (``keys``)."""
        before, mark = self.versions.current(), self.versions.begin()
        folder = uuid.uuid4().hex
        known = self._read(before)
        held = known.join(groups.select(*self.keys).distinct(), self.keys, "left_semi").select(self._of().alias(_PART)).distinct()
        touched = sorted(r[0] for r in held.collect())
        rest = self._read(before, touched).join(groups.select(*self.keys).distinct(), self.keys, "left_anti").withColumn(_PART, self._of())
        return self._commit(rest, folder, touched, before, mark)

    def _commit(self, rows: DataFrame, folder: str, touched: list[str], before: dict, mark: str) -> dict:
        if touched:
            self._write(rows, f"{self.path}/data/{folder}")
        schema = T.StructType([f for f in rows.schema.fields if f.name != _PART])
        content = {"parts": before.get("parts", {}) | dict.fromkeys(touched, folder), "schema": schema.jsonValue()}
        out = self.versions.commit(content, mark, before.get("version", 0))
        self.versions.folder.remove(f"staged/{mark}")
        return out

    def _write(self, rows: DataFrame, path: str) -> None:
        rows.write.partitionBy(_PART).parquet(path)

    def restore(self, content: dict) -> dict:
        """Makes an earlier manifest current again."""
        now = self.versions.current()
        return self.versions.commit({k: v for k, v in content.items() if k != "version"}, self.versions.begin(), now["version"])

    def vacuum(self) -> int:
        """Removes folders that no partition lies in; how many."""
        held = set(self.versions.current().get("parts", {}).values())
        loose = [f for f in self.versions.folder.names("data") if f not in held]
        for f in loose:
            self.versions.folder.remove(f"data/{f}")
        return len(loose)


def replace_together(changes: Sequence[tuple[ReplaceableTable, DataFrame]]) -> None:
    """Replaces groups in several tables; if one fails, those before it get their former rows back.

    A table that was empty before is emptied again.
    """
    done: list[tuple[ReplaceableTable, dict]] = []
    for table, rows in changes:
        before = table.versions.current()
        try:
            now = table.replace(rows)
        except Exception:
            for other, content in reversed(done):
                other.restore(content)
            raise
        done.append((table, before or {"parts": {}, "schema": now["schema"]}))
