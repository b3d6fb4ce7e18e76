"""Labelled rows: the fixed fold that is held out, and a bounded training sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import materialize

#: Most labelled rows that a classifier is fitted on.
SAMPLE_ROWS = 8_000


def held_out(doc_id: Column | str) -> Column:
    """True for the fold that no fit may learn from; a null id is not in it."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text: str = "text", max_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, y) of at most ``max_rows`` labelled documents outside the held-out fold.

    Ids are ranked by a hash, ties by the id, so reruns agree at every size.
    Null labels and ids are skipped; an id labelled twice counts with its higher
    label, and one with several rows gives one row, the text of the smallest
    hash.  The chosen ids are at most ``max_rows`` rows of 12 bytes: that bound,
    not the size of the label table, is what is broadcast, and no more rows than
    that are returned.
    """
    usable = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label).cast("int").alias("y")).filter("_id is not null and y is not null").filter(~held_out("_id"))
    usable = usable.groupBy("_id").agg(F.max("y").alias("y")).withColumn("_rank", F.xxhash64("_id"))
    # half as many again as asked for, and some, pass on average: the ranking then sees a bounded number of rows
    share = min(1.0, (1.5 * max_rows + 1000) / max(1, usable.count()))
    near = usable if share == 1.0 else usable.filter(F.col("_rank") < int((share - 0.5) * 2**64))
    chosen = near.orderBy("_rank", "_id").limit(max_rows).select("_id", "y")
    text_of = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).alias("text"))
    rows = text_of.join(F.broadcast(chosen), "_id")
    one = rows.groupBy("_id", "y").agg(F.min_by("text", F.struct(F.col("text").isNull(), F.xxhash64("text"), "text")).alias("text"))
    return materialize(spark, one.select("text", "y"), "labelled")
