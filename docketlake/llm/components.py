"""Connected components of an edge table of any size, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.llm.common import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.where("u > v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most_edges: int | None = None) -> DataFrame:
    """``(u, v)`` long pairs to ``(id, component)``: every id that has an edge, with the smallest id it reaches.

    Rounds alternate large and small stars until nothing changes; their number
    grows with the logarithm of the component size.  Each round is written, so
    lineage stays short and a lost executor repeats one round at most.  Minima
    are combined before they are shuffled and a hub's edges are a skewed join,
    which adaptive execution splits.  No edges give no rows.  ``most_edges`` bounds the
    rows of ``edges``, where that is known.
    """
    edges = edges.where("u is not null and v is not null and u <> v")
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, seen = materialise(edges, most_rows=most_edges), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        # A star moves edges, it adds none.
        edges = materialise(_small_star(_large_star(edges)), most_rows=state[0])
    leaves = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)
