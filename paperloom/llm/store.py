"""Shared-folder materialisation: cuts lineage and gives the optimizer real sizes.

Everything written here lands under ``spark.checkpoint.dir``, so a lost executor
never takes an intermediate result with it.  Where that is unset, a session on one
machine uses its warehouse folder; on a cluster that is an error.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor can read and write."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
    return base.rstrip("/")


def _write(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)  # the explicit schema keeps an empty result readable


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/paperloom/{name}-{uuid.uuid4().hex}"


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back."""
    return _write(spark, df, _path(spark, name))


class Scratch:
    """Written tables that only the steps before a final one read.

    Leaving the block removes their folders, so whatever outlives it must have
    been written elsewhere; ``last`` also removes all tables of its name before.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for _, path in self.paths:
            self._remove(path)

    def _remove(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append((name, path := _path(self.spark, name)))
        return _write(self.spark, df, path)

    def last(self, df: DataFrame, name: str) -> DataFrame:
        out = self.write(df, name)
        for old in [x for x in self.paths[:-1] if x[0] == name]:
            self.paths.remove(old)
            self._remove(old[1])
        return out
