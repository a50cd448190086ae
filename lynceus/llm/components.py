"""Connected components of a graph given by its edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (those above it, or itself and those below it) linked to the least of them all."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.where("b < a")
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    linked = both.join(least, "a").select(F.col("b").alias("x"), "a", "least")
    if large:
        out = linked.where("x > a").select(F.col("x").alias("a"), F.col("least").alias("b"))
    else:
        out = (linked.select(F.col("x").alias("a"), F.col("least").alias("b"))
               .unionByName(linked.select("a", F.col("least").alias("b"))))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of its component, for all nodes that have an edge and are not that least one.

    ``edges`` has a and b of one sortable type; loops and repeats do no harm. Rounds go on until nothing changes, each
    written to the shared folder; nothing is collected.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                 "components")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
        mark = seen
        now = stored(_star(_star(now, True), False), "components")
