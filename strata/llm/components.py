"""Connected components by alternating large-star and small-star, on edges that stay in the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.runtime import remove_written, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of u gets the least of u and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours get the least of them. edges: v <= u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (u long, v long) to (node, component), the least node reachable; only nodes with an edge to another are listed.

    Every round is written to the shared folder, so lineage stays short and a lost executor costs one stage.
    """
    tidy = lambda e: e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    state = written(tidy(edges), "components")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = mark(state)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        nxt = written(tidy(_small_star(tidy(_large_star(state)))), "components")
        now = mark(nxt)
        remove_written(state)
        state = nxt
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
