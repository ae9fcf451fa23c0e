"""Connected components of stored links by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brandweave.llm.common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest node around it."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least"))
    return both.where("v > u").join(least, "u").where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links the smaller neighbours of a node, and itself, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("least"))
    others = down.join(least, "u").where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return others.unionAll(least.select("u", F.col("least").alias("v"))).distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) of every node of links (u, v) of longs; the label is the smallest node of
    its component. Each round is stored in the shared folder and goes when the next one is, the
    last one with ``scratch``; rounds end
    when the links no longer change, after a number that grows with the logarithm of the component
    sizes. Links of a node to itself and repeated links do no harm; without links the result is empty.
    A star's centre may hold most links: the joins on it are inner joins, which Spark splits."""
    edges = links.where("u <> v").select("u", "v").distinct()
    before = held = None
    while True:
        turn = Scratch(links.sparkSession, scratch)
        edges = turn.stored(_small_star(_large_star(edges)), "stars", small=True)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if held:
            held.free()
        held = turn
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
