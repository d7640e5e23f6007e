"""Connected components of links, by alternating star operations on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewell.llm.common import cut


def _towards_minimum(edges: DataFrame, small: bool) -> DataFrame:
    """Every node's neighbours are linked to the least of them and itself: its larger ones, or (``small``) the others."""
    if small:
        sided = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = sided.groupBy("u").agg(F.min("v").alias("m"))
        moved = sided.join(least, "u").select(F.col("v").alias("b"), F.col("m").alias("a")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    else:
        sided = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = sided.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = sided.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return moved.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """doc_id and component_id (the smallest id that can be reached) of every node in ``links`` (a, b) but the smallest
    ones themselves. Rounds run until nothing moves; each is written, so no round is computed twice."""
    edges = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    was = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == was or now[0] == 0:
            break
        was = tuple(now)
        edges = cut(_towards_minimum(_towards_minimum(edges, small=False), small=True), "links")
    return edges.select(F.col("b").alias("doc_id"), F.col("a").alias("component_id"))
