"""Connected components of a link table, by alternating star contraction on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def _star(edges: DataFrame) -> DataFrame:
    """Every ``big`` end of an edge, and its smallest neighbour, point to that neighbour.
    The smallest neighbour comes from an aggregate (partial sums first), so a node with very many
    edges is joined back as a skewed join, never gathered."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return edges.join(least, "u").select("u", "v", "m")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges``: u, v (long, any order, u != v).  Returns node, root for every node that has an
    edge and is not itself the smallest node of its component.  Each round is checkpointed in the
    shared folder.  Null ends are not allowed; repeated edges count once."""
    ensure_checkpoint_dir(edges.sparkSession)
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    state = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _star(large)
        small = small.select("v", "m").where("v > m").unionByName(
            small.select(F.col("u").alias("v"), "m").where("v > m")
        )
        now = small.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().checkpoint()
        row = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()
        if tuple(row) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = tuple(row)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
