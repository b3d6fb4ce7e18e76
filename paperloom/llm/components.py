"""Connected components over an edge table, by alternating large and small stars.

Every round is a pre-aggregated minimum and a join on the node, both of which
Spark splits when one node holds many edges; the driver sees two numbers a
round.  Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Scratch, materialize


def components(spark: SparkSession, edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): its smallest node, written as ``name``.

    Self-loops, repeated and reversed edges are fine; nodes in no edge to
    another node are absent.  An empty edge table gives an empty result.
    """
    with Scratch(spark) as own:
        now = own.last(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
        while True:
            # done when every node has one edge, to a node that has none upwards
            one = now.groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
            if one.join(now.select(F.col("v").alias("c")).distinct(), F.col("u") == F.col("c"), "left").filter("lo <> hi or c is not null").isEmpty():
                return materialize(spark, now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct()), name)
            both = now.union(now.select("v", "u"))
            low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
            large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).distinct()
            now = own.last(small, "edges")
