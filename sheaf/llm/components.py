"""Connected components of a graph given by its edges, with large-star and small-star steps until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm import shared


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], int(r["h"] or 0)


def components(edges: DataFrame, folder: str, name: str = "edges") -> DataFrame:
    """(node, root) for each node with an edge, root being the least node of its component.  ``edges`` has longs u and v.

    Each step's edges are written to the shared folder.  Minima are aggregated before they are shuffled and the other
    steps are joins that Spark may split, so a node with very many edges is no bottleneck.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    edges = shared.table(edges, folder, f"{name}-0")
    state, step = _state(edges), 0
    while state[0]:
        step += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = shared.table(large, folder, f"{name}-{step}a")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = shared.table(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), folder, f"{name}-{step}b")
        new = _state(edges)
        if new == state:
            break
        state = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
