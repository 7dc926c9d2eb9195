"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from autoprofile.llm.common import settle


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (a, b), a > b, moved towards the smallest neighbour of each node.

    Large: every larger neighbour of a node is linked to the node's smallest neighbour.  Small:
    the node and its smaller neighbours are linked to the smallest of them.
    """
    if large:
        around = links.union(links.select("b", "a")).toDF("node", "near")
        least = around.groupBy("node").agg(F.min("near").alias("least"))
        moved = (
            around.filter("near > node")
            .join(least, "node")
            .select(F.col("near").alias("a"), F.least("node", "least").alias("b"))
        )
    else:
        least = links.groupBy("a").agg(F.min("b").alias("least"))
        others = links.join(least, "a").filter("b > least").select(F.col("b").alias("a"), "least")
        moved = others.union(least).toDF("a", "b")
    return moved.distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node reachable, for every node of a link.

    ``links``: two columns of node ids; direction, repeats and loops do not matter.  Every round
    is written to shared storage; rounds grow with the logarithm of the longest path.
    """
    a, b = (F.col(f"`{c}`") for c in links.columns)
    links = settle(
        links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .filter("a > b")
        .distinct()
    )
    before = None
    while True:
        links = settle(_star(_star(links, large=True), large=False))
        state = links.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.min("b")
        ).first()
        if state == before or not state[0]:
            break
        before = state
    roots = links.select("b").distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("b", "b")
    )
