"""Sinks and where stages put their tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation

# Table suffix of every stage.
STAGES = {
    "vertices": "_Vertices",
    "edges": "_Edges",
    "sentiment": "_Edges_Sentiment",
    "degrees": "_EdgesPlus",
    "belief_vertices": "_VerticesLBP",
    "belief_edges": "_EdgesLBP",
    "beliefs": "_Beliefs",
    "labels": "_Labels",
    "rejects": "_Rejects",
    "broken_reviews": "_BrokenReviews",
    "broken_products": "_BrokenProducts",
    "progress": "_Progress",
}


def stage_path(base: str, stage: str) -> str:
    """``base`` plus the stage's suffix, e.g. ``out/games_EdgesPlus.parquet``."""
    return f"{base}{STAGES[stage]}.parquet"


def write_table(
    df: DataFrame,
    path: str,
    mode: str = "errorifexists",
    cluster_by: tuple[str, ...] = (),
    partition_by: tuple[str, ...] = (),
) -> None:
    """Parquet, optionally hash-repartitioned by columns first or split into folders."""
    if cluster_by:
        df = df.repartition(*cluster_by)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_counted(df: DataFrame, path: str, counts: dict[str, Column], mode: str = "errorifexists") -> dict[str, int]:
    """Write ``df`` as parquet and return the named aggregates of its rows, taken by the write itself."""
    seen = Observation()
    observed = df.observe(seen, *[aggregate.alias(name) for name, aggregate in counts.items()])
    write_table(observed, path, mode)
    return seen.get


def write_degree_histogram(histogram: DataFrame, kind: str, path: str, mode: str = "errorifexists") -> None:
    """[degree, frequency] of one vertex type as CSV with a header."""
    histogram.where(histogram.type == kind).select("degree", "frequency").write.mode(mode).option(
        "header", True
    ).csv(path)
