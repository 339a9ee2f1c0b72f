"""Hubs and authorities."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.plans.cutting import cut
from plumbline.plans.skew import GROUP_LIMIT, HEAVY_KEY, add_group_sum, heavy_keys, if_any, lookup_join
from plumbline.sources.snapshots import write_snapshot


def normalise_by_max(scores: DataFrame, column: str) -> DataFrame:
    """``column`` divided by its maximum; 0 where the maximum is 0."""
    highest = scores.select(F.max(column).alias("m")).scalar()
    return scores.withColumn(column, F.coalesce(F.try_divide(F.col(column), highest), F.lit(0.0)))


def complete_scores(vertices: DataFrame, scores: DataFrame, column: str) -> DataFrame:
    """[id, column]: every score, and 0 for every vertex that has none."""
    return vertices.select("id").join(scores.select("id", column), "id", "full").withColumn(
        column, F.coalesce(column, F.lit(0.0))
    )


def hits(
    vertices: DataFrame,
    edges: DataFrame,
    iterations: int,
    hubs: DataFrame | None = None,
    snapshot_dir: str | None = None,
    cut_every: int = 5,
    group_limit: int = GROUP_LIMIT,
) -> tuple[DataFrame, DataFrame]:
    """(hubs [id, h_score], authorities [id, a_score]), largest score 1.

    An id that has edges but is not among ``vertices`` keeps the scores it gets.

    Every iteration sums hub scores over in-edges, then authority scores over
    out-edges; parallel edges count each time, so they are folded into one weighted
    edge up front, and the scores travel on the edges. Both sums are linear: dividing
    by the maximum only matters for the range of the numbers, so it is done where the
    plan is cut and at the end. ``snapshot_dir`` gets ``hubs/`` and ``authorities/``
    per iteration.
    """
    ids = vertices.select("id").distinct()
    if iterations < 1:
        first = ids.withColumn("h_score", F.lit(1.0)) if hubs is None else complete_scores(ids, hubs, "h_score")
        return first, ids.withColumn("a_score", F.lit(0.0))
    links = cut(edges.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight")))
    if hubs is None:
        links = links.withColumn("h_score", F.lit(1.0))
    else:
        known = hubs.select(F.col("id").alias("hub"), F.col("h_score").cast("double"))
        links = lookup_join(links, known, "src", "hub", "left", group_limit).fillna(0.0, ["h_score"])
    links, heavy_src = _mark_heavy(links, "src", group_limit)
    links, heavy_dst = _mark_heavy(links, "dst", group_limit)

    def scores(end: str, column: str) -> DataFrame:
        found = links.groupBy(F.col(end).alias("id")).agg(F.max(column).alias(column))
        return complete_scores(ids, normalise_by_max(found, column), column)

    for i in range(1, iterations + 1):
        links = add_group_sum(links.drop("a_score"), "dst", F.col("h_score") * F.col("weight"), "a_score", heavy_dst)
        links = add_group_sum(links.drop("h_score"), "src", F.col("a_score") * F.col("weight"), "h_score", heavy_src)
        if i == iterations or i % cut_every == 0 or snapshot_dir is not None:
            links = cut(links)
            top = links.agg(F.max("h_score")).first()[0]
            if top:
                links = links.withColumn("h_score", F.col("h_score") / F.lit(top))
        if snapshot_dir is not None:
            write_snapshot(scores("src", "h_score"), f"{snapshot_dir}/hubs", i)
            write_snapshot(scores("dst", "a_score"), f"{snapshot_dir}/authorities", i)
    return scores("src", "h_score"), scores("dst", "a_score")


def _mark_heavy(links, end, group_limit):
    """Links with a flag for heavy ``end`` ids, and that flag; no flag if there are none."""
    heavy = if_any(heavy_keys(links, end, group_limit))
    if heavy is None:
        return links, None
    flag = f"_heavy_{end}"
    listed = heavy.select(F.col(HEAVY_KEY).alias("_listed"), F.lit(True).alias(flag))
    marked = links.join(F.broadcast(listed), F.col(end) == F.col("_listed"), "left").drop("_listed")
    return marked.fillna(False, [flag]), F.col(flag)
