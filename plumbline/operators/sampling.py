"""Samples of exactly k edges per vertex, by the smallest hashes.

The k edges with the smallest hash are the same however the edges are spread, and the k
smallest of a union are among the k smallest of its parts: every task keeps at most k
rows a vertex (Spark puts a group limit before the shuffle for it), so a vertex that holds a
third of all edges sends k rows a task and not its edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.plans.cutting import stage
from plumbline.plans.skew import GROUP_LIMIT, lookup_join


def hash_position(edge_id: str = "edge_id") -> Column:
    """0 up to 1 from the md5 of an id, the same in every engine."""
    return F.conv(F.substring(F.md5(edge_id), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def bottom_k(edges: DataFrame, key: str, k: int, edge_id: str = "edge_id") -> DataFrame:
    """[key, edge_id, position, rank]: the ``k`` edges of every ``key`` with the smallest hash, smaller ids first on ties."""
    if k < 1:
        raise ValueError(f"k must be at least 1, not {k}")
    order = Window.partitionBy(key).orderBy("position", edge_id)
    placed = edges.where(F.col(key).isNotNull()).select(key, edge_id, hash_position(edge_id).alias("position"))
    return placed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mark_bottom_k(
    edges: DataFrame, key: str, degree: str, max_deg: int, k: int, marker: str, edge_id: str = "edge_id", limit: int = GROUP_LIMIT
) -> DataFrame:
    """Add the boolean ``marker``: all edges of a vertex below ``max_deg``, else its ``k`` with the smallest hash.

    Only the last kept hash of each such vertex is joined back, with salted groups for heavy ones.
    """
    last = bottom_k(edges.where(F.col(degree) >= max_deg), key, k, edge_id).where(F.col("rank") == k)
    last = stage(last.select(F.col(key).alias("_of"), F.struct("position", edge_id).alias("_last")), "last-kept")
    met = lookup_join(edges, last, key, "_of", "left", limit, [edge_id])
    own = F.struct(hash_position(edge_id).alias("position"), F.col(edge_id))
    return met.withColumn(marker, F.coalesce(own <= F.col("_last"), F.lit(True))).drop("_last")
