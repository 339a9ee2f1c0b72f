"""Merging the graphs of several categories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from plumbline.operators.beliefs import PRIORS
from plumbline.operators.graph import degrees, with_endpoint_degrees
from plumbline.plans.cutting import stage
from plumbline.plans.skew import GROUP_LIMIT


def _tagged(parts: list[tuple[DataFrame, str]]) -> DataFrame:
    """All vertices with their ``tag`` and its ``position`` in the list."""
    tags = [tag for _, tag in parts]
    if len(set(tags)) != len(tags):
        raise ValueError(f"category tags must differ: {tags}")
    frames = [
        vertices.select("id", "type", "deg", *PRIORS).withColumns({"tag": F.lit(tag), "position": F.lit(i)})
        for i, (vertices, tag) in enumerate(parts)
    ]
    return reduce(DataFrame.unionByName, frames)


def _first_priors():
    """Priors of the earliest category that lists the vertex."""
    return F.min_by(F.struct(*PRIORS), "position").alias("priors")


def merge_vertices(parts: list[tuple[DataFrame, str]]) -> DataFrame:
    """[id, type, deg, priors, category]: one row per vertex, its degrees added up.

    ``category`` lists its tags in alphabetical order.
    """
    return (
        _tagged(parts)
        .groupBy("id", "type")
        .agg(F.sum("deg").alias("deg"), _first_priors(), F.array_sort(F.collect_set("tag")).alias("category"))
        .select("id", "type", "deg", "priors.*", "category")
    )


def merge_categories(
    vertex_parts: list[tuple[DataFrame, str]], edge_parts: list[DataFrame], limit: int = GROUP_LIMIT
) -> tuple[DataFrame, DataFrame]:
    """One graph from the belief graphs of several categories.

    Vertices are the endpoints of the united edges, with their new degree, priors and
    one 0/1 column per category; edges get new degrees and singleton flags.
    """
    edges = union_all_by_name(edge_parts)
    counted = stage(degrees(edges), "degrees")
    tags = [tag for _, tag in vertex_parts]
    known = (
        _tagged(vertex_parts)
        .groupBy("id", "type")
        .agg(_first_priors(), *[F.max(F.when(F.col("tag") == t, 1).otherwise(0)).alias(t) for t in tags])
    )
    vertices = counted.join(known, ["id", "type"], "left").select(
        "id", "type", "deg", "priors.*", *[F.coalesce(t, F.lit(0)).alias(t) for t in tags]
    )
    bare = edges.drop("u_deg", "single_user", "p_deg", "single_product")
    return vertices, with_endpoint_degrees(bare, counted, limit).select(edges.columns)


def union_all(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of both, columns matched by position."""
    return first.union(second)


def union_all_by_name(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts, columns matched by name."""
    return reduce(DataFrame.unionByName, parts)


def except_all(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of ``first`` less one copy per equal row of ``second``."""
    return first.exceptAll(second)


def intersect(first: DataFrame, second: DataFrame) -> DataFrame:
    """Distinct rows that are in both."""
    return first.intersect(second)


def except_ids(first: DataFrame, second: DataFrame) -> DataFrame:
    """Distinct [id] of ``first`` that ``second`` does not have."""
    return first.select("id").distinct().join(second.select("id"), "id", "left_anti")
