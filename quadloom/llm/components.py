"""Connected components of a link table, by rounds of star contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm._shared import cut


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a long, b long), root being the component's smallest node.

    Alternates large-star and small-star steps. Each is one aggregation by key and
    one join back; the number of links never grows, so a hub with many neighbours is
    only as heavy as its own links, and hubs are split by the adaptive skew join.
    Self links count as nodes. Each round is written to the checkpoint folder. Rounds end
    when the links have become stars, which is looked at once their hash stays the same.
    """
    edges = cut(_ordered(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))))
    state = None
    while True:
        edges = cut(_small_star(_large_star(edges)))
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state and _done(edges):
            break
        state = now
    nodes = links.select(F.col("a").cast("long").alias("node")).union(links.select(F.col("b").cast("long"))).distinct()
    return nodes.join(edges.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").groupBy("node").agg(F.min(F.coalesce("root", "node")).alias("root"))


def _done(edges: DataFrame) -> bool:
    """Whether every node hangs on one node alone that hangs on none: the smallest of its component, since links go to smaller nodes."""
    inner = edges.join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
    return inner.isEmpty() and edges.groupBy("a").count().where("count > 1").isEmpty()


def _ordered(edges: DataFrame) -> DataFrame:
    """Each link once, from its larger to its smaller end."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest node around it."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    edges = _ordered(edges)
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
