"""Connected components of a distributed edge list by alternating star contractions.

The edges of a node meet its smallest neighbour in SALTS parts, so that a node with very many edges
is no single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townlake.llm.common import stored


#: Parts of a node's edges.
SALTS = 8


def _met(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` with the ``m`` of their u."""
    copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    own = F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")
    return edges.withColumn("salt", own).join(least.withColumn("salt", copies), ["u", "salt"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return _met(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link the smaller neighbours of a node, and the node itself, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _met(down, least).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge, root being the smallest node of its component.

    ``edges`` has (u, v) in any direction, with repeats or self-links. Only sums of the edges
    reach the driver. Ends when a round changes nothing, after about log(nodes) rounds. Each round is a
    written table: a checkpoint keeps the estimated size of its plan, which grows to a power by rounds.
    """
    edges = stored(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        sums = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if sums == state:
            break
        state = sums
        edges = stored(_small_star(_large_star(edges)), "edges")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
