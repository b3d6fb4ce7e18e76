"""The folder that the driver and all executors share, and numbered manifests in it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a folder of the warehouse, on one machine only."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
    return base.rstrip("/")


def stored(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: rounds do not pile up in its plan."""
    path = f"{shared_dir(spark)}/paperloom/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Folder:
    """Files of one folder, whatever store it is in."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, under: str) -> list[str]:
        at = self._at(f"{self.path}/{under}")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(f"{self.path}/{name}"))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(f"{self.path}/{name}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, content: str) -> None:
        """Writes a new file; an error if there is one."""
        stream = self._fs.create(self._at(f"{self.path}/{name}"), False)
        stream.write(bytearray(content.encode()))
        stream.close()

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(f"{self.path}/{name}"), True)


class Conflict(RuntimeError):
    """Another writer committed first."""


class Versions:
    """Numbered manifests of a folder: the highest that can be read is what the folder holds.

    Data files are written first and named by a manifest afterwards, so a write
    that fails half-way changes nothing that readers see.  A writer takes a
    mark before it begins and removes it when it commits; marks that stay tell of
    failed writes.  Two writers of one version cannot both commit it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.folder = Folder(spark, path)

    def _numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.folder.names("manifests") if n.endswith(".json")]

    def current(self) -> dict:
        """The newest manifest with its number as ``version``; empty without one."""
        for number in reversed(self._numbers()):
            try:
                return json.loads(self.folder.read(f"manifests/{number:08d}.json")) | {"version": number}
            except ValueError:  # the writer died while it wrote it
                continue
        return {}

    def begin(self) -> str:
        mark = uuid.uuid4().hex
        self.folder.create(f"pending/{mark}", "")
        return mark

    def pending(self) -> list[str]:
        return self.folder.names("pending")

    def commit(self, content: dict, mark: str, after: int) -> dict:
        """Makes ``content`` current; a ``Conflict`` if the folder is no longer at version ``after``."""
        if self.current().get("version", 0) != after:
            raise Conflict(f"version {after} is no longer the current one")
        number = max([after, *self._numbers()]) + 1
        try:
            self.folder.create(f"manifests/{number:08d}.json", json.dumps(content))
        except Exception as error:
            raise Conflict(f"version {number} was committed by another writer") from error
        self.folder.remove(f"pending/{mark}")
        return content | {"version": number}

    def forget(self) -> None:
        """Drops the marks of failed writes."""
        for mark in self.pending():
            self.folder.remove(f"pending/{mark}")


def stamp(spark: SparkSession, df: DataFrame) -> str:
    """What the files behind a table look like: names, sizes and times; changes when any of them does."""
    conf, at = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    found = []
    for name in sorted(df.inputFiles()):
        path = at(spark._jvm.java.net.URI(name))
        status = path.getFileSystem(conf).getFileStatus(path)
        found.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return str(uuid.uuid5(uuid.NAMESPACE_OID, "\n".join(found)))
