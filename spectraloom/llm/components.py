"""Connected components of an edge table, as a DataFrame loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, materialize


def _to_least(pairs: DataFrame) -> DataFrame:
    """Neighbours (u, v) of each u, with the least of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("_m")).select(F.col("u").alias("_u"), F.least("_m", "u").alias("m"))
    return pairs.join(least, F.col("u") == F.col("_u")).select("u", "v", "m")


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) -> (node, component): component is the least node that can be reached. Nodes without edges are not in the result.

    Alternates large-star and small-star steps, which keep connectivity and end in
    stars around the least nodes. Minima combine before the shuffle and joins are
    on plain keys, so that a node with very many neighbours can be split. Each
    round is written to the shared folder.
    """
    now = materialize(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    seen = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        near = _to_least(large)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        after = materialize(small, "components")
        drop_scratch(now.sparkSession, now._scratch)
        now = after
        state = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
