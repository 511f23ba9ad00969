"""Connected components over an edge list, by alternating large-star and small-star rounds.

Each round is two groupings and two joins on a node id. The edge table is cut
into shared storage after each round, so a lost executor costs one round at most
and no edge ever reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import drop_path, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def star_edges(pairs: DataFrame, src: str, dst: str, rounds: int = 60) -> DataFrame:
    """(u, v): every node that has a smaller node in its component, with the smallest one.

    Self loops and null ends are ignored. Nodes that are their component's
    smallest, and nodes without edges, have no row.
    """
    edges = materialise(
        pairs.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
        .select(F.greatest(src, dst).cast("long").alias("u"), F.least(src, dst).cast("long").alias("v"))
        .distinct(),
        "edges",
    )
    mark = None
    for _ in range(rounds):
        seen = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (seen.n, seen.h) == mark or not seen.n:
            return edges
        mark = (seen.n, seen.h)
        last, edges = edges, materialise(_small_star(_large_star(edges)), "edges")
        drop_path(edges.sparkSession, last._scratch_path)
    raise RuntimeError(f"no fixed point after {rounds} rounds")


def connected_components(nodes: DataFrame, node: str, pairs: DataFrame, src: str, dst: str) -> DataFrame:
    """``nodes`` with ``component_id``: the smallest node id reachable over ``pairs``, itself included."""
    stars = star_edges(pairs, src, dst)
    return nodes.join(stars.withColumnsRenamed({"u": node, "v": "__root"}), node, "left").withColumn(
        "component_id", F.coalesce("__root", F.col(node).cast("long"))
    ).drop("__root")
