"""Rows that pass through Python with columns of any names and types."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def quoted(name: str) -> str:
    """A column's name as an expression reads it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``df.mapInArrow(run, schema)``; Spark knows the columns by place, ``run`` by name."""
    given, made = df.columns, [f"c{i}" for i in range(len(schema))]

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batch.rename_columns(given) for batch in batches):
            yield batch.rename_columns(made)

    inner = T.StructType([T.StructField(c, f.dataType) for c, f in zip(made, schema)])
    return df.toDF(*(f"c{i}" for i in range(len(given)))).mapInArrow(renamed, inner).toDF(*schema.names)
