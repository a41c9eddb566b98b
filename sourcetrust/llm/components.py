"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sourcetrust.llm.tables import Workspace


def components(links: DataFrame, space: Workspace, name: str = "components") -> DataFrame:
    """node, component (smallest node reachable) for every node of the links (columns a, b: bigint).

    Each round hangs larger neighbours below a node's smallest neighbour, then does the same among
    the smaller ones, until all components are stars; the rounds grow with the logarithm of the
    longest chain. A round is stored in the shared folder and the one before it removed. No round
    gathers a node's neighbours: minima are partial aggregates, and a hot centre is split by the
    adaptive join. Links of a node with itself or with null are ignored.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = space.keep(edges.distinct(), f"{name}-0")
    done = 0
    while not _stars(edges):
        lowest = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = lowest.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        large = edges.join(lowest, F.col("v") == F.col("w")).select("u", F.least("m", "v").alias("v")).distinct()
        below = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        small = large.join(below, F.col("u") == F.col("w"))
        small = small.select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))
        )).alias("e")).select("e.*").filter("u <> v")
        edges = space.keep(small.distinct(), f"{name}-{done + 1}")
        space.drop(f"{name}-{done}")
        done += 1
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _stars(edges: DataFrame) -> bool:
    """Every node hangs below one other, which hangs below none."""
    parents = edges.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("low"), F.max("v").alias("high"))
    if not parents.filter("low <> high").isEmpty():
        return False
    return edges.join(parents, F.col("v") == F.col("w"), "left_semi").isEmpty()
