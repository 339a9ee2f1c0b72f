"""The whole chain, from raw files to labelled reviews.

Each stage reads the tables of the stages before it and writes its own, so a run can
be taken up again at any of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.operators.active import run_lbp_active
from plumbline.operators.beliefs import Sampling, boost_priors, init_beliefs, node_beliefs, run_lbp, unscored_counts
from plumbline.operators.fusion import fuse_review_labels, unlabelled_counts
from plumbline.operators.graph import build_graph, repeat_reviews, with_endpoint_degrees
from plumbline.operators.merge import merge_categories
from plumbline.operators.scoring import rejected_counts, repair_zero_compound, review_score
from plumbline.operators.sentiment import lexicon_sentiment
from plumbline.plans.cutting import stage, staging
from plumbline.sources.clustered import read_clustered, write_clustered
from plumbline.sources.readers import broken_lines, read_products, read_reviews, read_table, watched
from plumbline.sources.snapshots import last_iteration, read_snapshot
from plumbline.sources.writers import stage_path, write_counted, write_table

TEXTS = ("summary", "review_text")


def add_sentiment(
    edges: DataFrame, lexicon: DataFrame, repair: bool = False, **score_options
) -> DataFrame:
    """Edges with neg, neu, pos, compound, pos_or_neg and ``s`` from their ``review_text``.

    ``repair`` replaces zero compounds first. Nothing after this needs the texts, so
    they are left out and never shuffled for it.
    """
    moods = lexicon_sentiment(edges, "edge_id", "review_text", lexicon)
    scored = edges.drop(*TEXTS).join(moods, "edge_id")
    if repair:
        scored = repair_zero_compound(scored)
    return review_score(scored, **score_options)


def prepare(
    spark: SparkSession, reviews_path: str, products_path: str, base: str, edge_label: str, lexicon: DataFrame,
    repair: bool = False, boost: bool = False, carry: tuple[str, ...] = (), **score_options,
) -> None:
    """From review and product JSON to belief tables, every stage written under ``base``.

    ``boost`` raises priors where a user reviewed a product more than once at one time.
    ``carry`` names edge columns that the labels shall have too. The table of rejects
    counts unusable ratings and votes, edges without a score, and lines that are no
    record; those lines go to tables of their own, if there are any. All of it is counted
    on writes that happen anyway.
    """
    with staging(spark):
        reviews, review_watch = watched(read_reviews(spark, reviews_path, keep_broken=True))
        products, product_watch = watched(read_products(spark, products_path, keep_broken=True))
        graph = build_graph(reviews, products.distinct(), edge_label)
        write_table(graph.vertices, stage_path(base, "vertices"))
        rejects = write_counted(graph.edges, stage_path(base, "edges"), rejected_counts())

        edges = read_table(spark, stage_path(base, "edges"), graph.edges.schema)
        write_table(add_sentiment(edges, lexicon, repair, **score_options), stage_path(base, "sentiment"))

        vertices = read_table(spark, stage_path(base, "vertices"), graph.vertices.schema)
        scored = read_table(spark, stage_path(base, "sentiment"))
        enriched = with_endpoint_degrees(scored, vertices)
        rejects |= write_counted(enriched, stage_path(base, "degrees"), unscored_counts())

        enriched = read_table(spark, stage_path(base, "degrees"))
        belief_vertices, belief_edges = init_beliefs(vertices, enriched, carry=carry)
        if boost:
            belief_vertices, belief_edges = boost_priors(belief_vertices, belief_edges, stage(repeat_reviews(enriched), "repeats"))
        write_table(belief_vertices, stage_path(base, "belief_vertices"))
        write_clustered(stage(belief_edges, "belief-edges"), stage_path(base, "belief_edges"), "src")
        for name, watch, read, path in (
            ("broken_reviews", review_watch, read_reviews, reviews_path),
            ("broken_products", product_watch, read_products, products_path),
        ):
            rejects[name] = 0
            if watch.get["broken"]:
                rejects |= write_counted(broken_lines(read(spark, path, keep_broken=True)), stage_path(base, name), {name: F.count(F.lit(1))})
        _write_counts(spark, rejects, stage_path(base, "rejects"))


def merge(spark: SparkSession, parts: list[tuple[str, str]], base: str) -> None:
    """The belief tables of several prepared categories as one graph under ``base``.

    ``parts`` lists (base, tag) of each category. The merged edges are written clustered
    by user, where the first half-step of belief propagation needs them.
    """
    with staging(spark):
        vertex_parts = [(read_table(spark, stage_path(b, "belief_vertices")), tag) for b, tag in parts]
        edge_parts = [read_table(spark, stage_path(b, "belief_edges")) for b, _ in parts]
        vertices, edges = merge_categories(vertex_parts, edge_parts)
        write_table(vertices, stage_path(base, "belief_vertices"))
        write_clustered(stage(edges, "belief-edges"), stage_path(base, "belief_edges"), "src")


def infer(
    spark: SparkSession, base: str, iterations: int, start: int | None = 1, snapshot_dir: str | None = None,
    sampling: Sampling | None = None, sign_mag_effect: bool = True, carry: tuple[str, ...] = (), tolerance: float | None = None,
) -> DataFrame:
    """Propagate beliefs over the tables under ``base``, write beliefs and labels, return the labels.

    With ``start`` above 1 the edges come from snapshot ``start - 1``; None goes on after the
    last finished one until ``iterations`` rounds are there in all. ``carry`` names
    columns of the belief edges that the labels keep. With a ``tolerance`` only vertices whose
    evidence moved by more are recomputed, without snapshots. Whatever is staged on the way is
    removed. The table of progress counts edges and unlabelled edges, as they are written.
    """
    if snapshot_dir is None and start != 1:
        raise ValueError("resuming needs the snapshot folder")
    if snapshot_dir is not None and tolerance is not None:
        raise ValueError("an active set writes no snapshots")
    if start is None:
        start = (last_iteration(spark, snapshot_dir) or 0) + 1
        iterations = max(iterations - start + 1, 0)
    with staging(spark):
        vertices = read_table(spark, stage_path(base, "belief_vertices"))
        edges = read_clustered(spark, stage_path(base, "belief_edges"))
        if start > 1:
            edges = read_snapshot(spark, snapshot_dir, start - 1, edges.schema)
        if tolerance is not None:
            settled, _ = run_lbp_active(edges, iterations, tolerance, sign_mag_effect, sampling)
        else:
            settled = run_lbp(edges, iterations, start, sign_mag_effect, sampling, snapshot_dir)
        write_table(node_beliefs(vertices, settled, sampling), stage_path(base, "beliefs"))
        beliefs = read_table(spark, stage_path(base, "beliefs"))
        labels = fuse_review_labels(beliefs, settled, carry)
        counts = write_counted(labels, stage_path(base, "labels"), unlabelled_counts())
        _write_counts(spark, counts, stage_path(base, "progress"))
    return read_table(spark, stage_path(base, "labels"))


def _write_counts(spark: SparkSession, counts: dict[str, int], path: str) -> None:
    """One row of counts as a table."""
    schema = ", ".join(f"{name} bigint" for name in counts)
    write_table(spark.createDataFrame([tuple(counts.values())], schema), path)
