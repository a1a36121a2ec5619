"""Connected components of an edge table by alternating large and small stars, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.tables import growing, store


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: neighbours greater than a node move to its least neighbour. Small star: lesser ones and itself do."""
    ways = _both(edges) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = ways.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = ways.join(growing(least), "a")
    moved = joined.where("b > a").select("b", "m") if large else joined.select("b", "m").unionAll(least.select("a", "m"))
    return moved.toDF("a", "b").where("a <> b").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, label): every id of an edge with the least id of its component.

    Node labels travel by sort-merge joins with map-side minima; hot nodes are split by AQE. The rounds grow with the
    logarithm of the longest path; every round is a written table.
    """
    now = store(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct(), "edges")
    mark = None
    while True:
        now = store(_star(_star(now, True), False), "stars")
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"), F.sum(F.expr("CAST(b AS DECIMAL(38,0))")).alias("s")).first()
        if tuple(row) == mark:
            break
        mark = tuple(row)
    labels = now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("label"))
    return labels.unionAll(labels.select(F.col("label").alias("id"), "label").distinct())
