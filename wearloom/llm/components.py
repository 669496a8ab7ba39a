"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearloom.llm.common import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _star(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """One round, written. edges: (u, v) with v < u, about so many rows. The minima are written
    first, so that both sides of the join are plain exchanges and a hot node's rows can be split."""
    pairs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = written(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), rows)
    joined = pairs.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return written(out.where("u <> v").distinct(), rows)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge: component is its least reachable node.

    edges: two columns of longs, in any order, repeats and loops allowed. A node that
    has no edge to another one is not returned. Rounds grow with the logarithm of the
    node count; each writes its edges to the shared folder,
    in as many files as the edges fill.
    """
    a, b = (F.col(c) for c in edges.columns[:2])
    edges = written(
        edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    before = _state(edges)
    while before[0]:
        edges = _star(_star(edges, True, before[0]), False, before[0])
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
