"""Belief propagation that recomputes only vertices whose evidence has moved.

A half-step needs the edges of a vertex together, which is a shuffle. A vertex all of
whose incoming messages are what they were when it was last computed would send the
same messages again, so its edges stay where they are. Every edge keeps the two messages as
their vertices last saw them; drift adds up against those, not from round to round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from plumbline.operators import beliefs
from plumbline.operators.beliefs import _PRODUCTS, _USERS, Sampling
from plumbline.plans.cutting import remove, scratch_path, stage, staging
from plumbline.plans.skew import GROUP_LIMIT, lookup_join

#: Ids of moved vertices up to this number are broadcast; more are joined with salted keys.
BROADCAST_IDS = 1_000_000

_SEEN = {"src": "_mu_seen", "dst": "_mp_seen"}


def run_lbp_active(
    edges: DataFrame,
    iterations: int,
    tolerance: float = 0.0,
    sign_mag_effect: bool = True,
    sampling: Sampling | None = None,
    group_limit: int = GROUP_LIMIT,
    broadcast_ids: int = BROADCAST_IDS,
) -> tuple[DataFrame, DataFrame]:
    """Belief edges after up to ``iterations`` rounds, and [iteration, side, shuffled_edges, edges].

    A vertex is recomputed if the log-odds of a message it hears differ by more than
    ``tolerance`` from those it was last computed with; at 0 the result is that of
    :func:`beliefs.run_lbp`. Rounds end early once nothing moves; the report has a row for
    every half-step that was looked at. The state is written after every half-step that
    changes it, and only the newest is kept.
    """
    spark = edges.sparkSession
    report: list[tuple[int, str, int, int]] = []
    with staging(spark):
        state, place = _written(
            beliefs._compact(beliefs._sampled(edges, sampling, group_limit)).withColumns({c: F.lit(None).cast("double") for c in _SEEN.values()}), None
        )
        facts = state.agg(F.count(F.lit(1)).alias("n"), F.max("u_deg").alias("u_deg"), F.max("p_deg").alias("p_deg")).first()
        for i in range(1, iterations + 1):
            moved = 0
            for side, name in ((_USERS, "user"), (_PRODUCTS, "product")):
                heavy = (facts[side.degree] or 0) > group_limit
                parts = _apart(state, side, tolerance, sampling, group_limit, broadcast_ids)
                shuffled = 0
                if parts is not None:
                    seen = Observation()
                    stepped = beliefs._half_step(parts[0], side, sign_mag_effect, sampling, group_limit, heavy)
                    stepped = stepped.withColumn(_SEEN[side.key], beliefs._heard(side, sampling)).observe(seen, F.count(F.lit(1)).alias("n"))
                    state, place = _written(stepped.unionByName(parts[1]), place)
                    shuffled = seen.get["n"]
                report.append((i, name, shuffled, facts["n"]))
                moved += shuffled
            if not moved:
                break
        path = scratch_path(spark, "settled", outer=True)
        beliefs._expand(state, edges.columns).write.parquet(path)
    rounds = spark.createDataFrame(report, "iteration int, side string, shuffled_edges bigint, edges bigint")
    return spark.read.schema(edges.schema).parquet(path), rounds


def _apart(state, side, tolerance, sampling, group_limit, broadcast_ids) -> tuple[DataFrame, DataFrame] | None:
    """The edges of vertices that must be recomputed and all others; None if there are none of the former."""
    seen = F.col(_SEEN[side.key])
    drift = seen.isNull() | (F.abs(beliefs._heard(side, sampling) - seen) > F.lit(float(tolerance)))
    moved = stage(state.where(~F.col(side.single) & drift).select(F.col(side.key).alias("_moved")).distinct(), "moved")
    n = moved.count()
    if not n:
        return None
    marked = moved.withColumn("_hot", F.lit(True))
    if n <= broadcast_ids:
        rows = state.join(F.broadcast(marked), F.col(side.key) == F.col("_moved"), "left").drop("_moved")
    else:
        rows = lookup_join(state, marked, side.key, "_moved", "left", group_limit, ["edge_id"])
    hot = F.coalesce("_hot", F.lit(False))
    return rows.where(hot).drop("_hot"), rows.where(~hot).drop("_hot")


def _written(state: DataFrame, before: str | None) -> tuple[DataFrame, str]:
    """The state as a table, which replaces the one before."""
    spark = state.sparkSession
    path = scratch_path(spark, "beliefs")
    state.write.parquet(path)
    if before is not None:
        remove(spark, before)
    return spark.read.schema(state.schema).parquet(path), path
