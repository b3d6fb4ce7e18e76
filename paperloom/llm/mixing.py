"""Mixing sources to target weights by nested hash thresholds.

Each document has a 36-bit position, a hash of its id.  Words are summed by
source and the position's first 12 bits; running sums find the bucket in which a
source's budget runs out.  Only that boundary bucket is summed again by its next
12 bits, and then once more.  The three digits together are one threshold: a
document below it is taken once more than the others.  Nothing is sorted, and
the only per-source state is one row and its histogram.

Targets come from weights by source rank, bounded by a multiple of the source's
size; what a bounded source cannot take is shared out again by weight, which in
closed form is a water level over the sources ordered by bound per weight.

Edge cases: a null or empty text has size 0 and is taken 0 words; a null source
is a source of its own, last in order; a null id is placed by its text; rows
with the same id share a position, so they are taken alike.  The result depends
on the rows alone.  Extra columns, whatever their names, are kept by ``mix``.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Bits of each of the three nested histograms.
DIGIT = 12


def _placed(docs: DataFrame, id_col: str, source: str, text: str) -> DataFrame:
    """_row (the whole row), _source, _size and _place of each document."""
    name = F.coalesce(F.col(id_col).cast("string"), F.col(text), F.lit(""))
    place = F.conv(F.substring(F.md5(name), 1, 3 * DIGIT // 4), 16, 10).cast("long")
    return docs.select(F.struct("*").alias("_row"), F.col(source).alias("_source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("_size"), place.alias("_place"))


def _targets(totals: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(_source, _all, _target) from (_source, _all); one row for each source.

    Windows run over that small table alone, not over documents.
    """
    rank = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double")
    s = totals.withColumn("w", weight).withColumn("bound", F.lit(float(most)) * F.col("_all"))
    by = Window.orderBy(F.col("bound") / F.col("w"), F.col("_source").asc_nulls_last())
    every = Window.partitionBy()
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({
        "level": (F.sum("_all").over(every) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing)),
        "full": F.lit(False),
    })
    s = s.withColumn("full", F.col("bound") <= F.col("level") * F.col("w"))
    free = F.sum("_all").over(every) - F.coalesce(F.sum(F.when(F.col("full"), F.col("bound"))).over(every), F.lit(0.0))
    share = free / F.sum(F.when(~F.col("full"), F.col("w"))).over(every)
    return s.select("_source", "_all", F.when(F.col("full"), F.col("bound")).otherwise(F.least("bound", share * F.col("w"))).alias("_target"))


def _boundary(histogram: DataFrame) -> DataFrame:
    """(_source, _digit, _left): the first bucket that the budget cannot hold whole.

    A budget that holds every bucket ends behind the last digit.
    """
    by = Window.partitionBy("_source").orderBy("_digit")
    run = histogram.withColumn("_upto", F.sum("_words").over(by))
    stop = F.col("_upto") > F.col("_left")
    return run.groupBy("_source").agg(
        F.coalesce(F.min(F.when(stop, F.col("_digit"))), F.lit(1 << DIGIT)).alias("_digit"),
        (F.first("_left") - F.coalesce(F.max(F.when(~stop, F.col("_upto"))), F.lit(0))).alias("_left"),
    )


def plan_mix(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, id_col: str = "doc_id", source: str = "source", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(placed rows, thresholds): everything needed to take documents.

    thresholds has _source, _all, _target, _copies and _below: a document is
    taken ``_copies`` times, and once more if its place is under ``_below``.
    """
    placed = _placed(docs, id_col, source, text)
    placed = materialize(spark, placed.select(F.col("_row").getField(id_col).alias(id_col), "_source", "_size", "_place"), "placed")
    digit = lambda k: F.shiftright("_place", DIGIT * (2 - k)).bitwiseAND((1 << DIGIT) - 1)
    same = lambda a, b: a["_source"].eqNullSafe(b["_source"])

    first = materialize(spark, placed.groupBy("_source", digit(0).alias("_digit")).agg(F.sum("_size").alias("_words")), "histogram")
    target = _targets(first.groupBy("_source").agg(F.sum("_words").alias("_all")), weights, most)
    copies = F.when(F.col("_all") > 0, F.floor(F.col("_target") / F.col("_all"))).otherwise(F.lit(0)).cast("long")
    target = target.withColumn("_copies", copies).withColumn("_left", F.col("_target") - F.col("_copies") * F.col("_all"))
    target = materialize(spark, target, "targets")

    edge, known, histogram = target.select("_source", "_left", F.lit(0).cast("long").alias("_path")), None, first
    for k in range(3):
        if k:
            inside = placed.join(edge.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s")) & (F.shiftright("_place", DIGIT * (3 - k)) == F.col("_path")))
            histogram = inside.groupBy("_source", digit(k).alias("_digit")).agg(F.sum("_size").alias("_words"))
        e = edge.withColumnRenamed("_source", "_s")
        found = _boundary(histogram.join(e, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s", "_path"))
        f = found.select(F.col("_source").alias("_s"), F.col("_digit"), F.col("_left").alias("_rest"))
        # a bucket without rows below it keeps its path: nothing is left to divide
        edge = edge.join(f, F.col("_source").eqNullSafe(F.col("_s")), "left").select("_source", F.coalesce("_rest", "_left").alias("_left"), (F.col("_path") * (1 << DIGIT) + F.coalesce("_digit", F.lit(0))).alias("_path"))
        edge = materialize(spark, edge, f"edge{k}")
    # the last bucket is taken whole if that comes nearer to the budget
    last = placed.join(edge.select(F.col("_source").alias("_s"), "_path"), F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_place") == F.col("_path"))).groupBy("_s").agg(F.sum("_size").alias("_words"))
    e = edge.join(last, edge["_source"].eqNullSafe(last["_s"]), "left").select(F.col("_source").alias("_s"), F.when(2 * F.col("_left") > F.coalesce("_words", F.lit(0)), F.col("_path") + 1).otherwise(F.col("_path")).alias("_below"))
    known = target.join(e, F.col("_source").eqNullSafe(F.col("_s"))).select("_source", "_all", "_target", "_copies", "_below")
    return placed, materialize(spark, known, "thresholds")


def _taken(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """rows with the threshold columns and _times, how often each is taken.

    The thresholds are one row for each source, read back from a file: Spark
    broadcasts them while they are small, and else splits the large sources.
    """
    t = thresholds.withColumnRenamed("_source", "_s")
    joined = rows.join(t, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    return joined.withColumn("_times", F.col("_copies") + (F.col("_place") < F.col("_below")).cast("long"))


def assess(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(id, size, source_size, target, taken) of every row."""
    rows, thresholds = plan_mix(spark, docs, id_col=id_col, source=source, text=text)
    return _taken(rows, thresholds).select(id_col, F.col("_size").alias("size"), F.col("_all").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_times")).alias("taken"))


def mix(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mixed documents: each row as often as it is taken, columns unchanged."""
    _, thresholds = plan_mix(spark, docs, id_col=id_col, source=source, text=text)
    taken = _taken(_placed(docs, id_col, source, text), thresholds)
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).filter("_times > 0").select("_row.*")
