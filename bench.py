"""Time the headline operators; prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores. Operators start from
staged tables, as the stages of the pipeline do; results go to a sink that discards
them. ``lbp_iteration`` is the mean of ten belief-propagation rounds.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from plumbline.operators import beliefs, components, fusion, graph, hits, reports, scoring
from plumbline.operators.numbering import number_rows
from plumbline.operators.sentiment import lexicon_sentiment
from plumbline.plans import catalog
from plumbline.plans.cutting import stage
from plumbline.sources import commerce

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ROUNDS = 10


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    spark = session()
    taken: dict[str, float] = {}

    def timed(name: str, make, keep: bool = False):
        began = time.perf_counter()
        frame = make()
        if keep:
            frame = stage(frame, name)
        elif isinstance(frame, DataFrame):
            frame.write.format("noop").mode("overwrite").save()
        taken[name] = round(time.perf_counter() - began, 3)
        print(f"{name} {taken[name]}", file=sys.stderr, flush=True)
        return frame

    # one small pass, so that class loading is not charged to the first query
    spark.read.parquet(f"{FOLDER}/lineitem.parquet").groupBy("l_returnflag").count().collect()

    raw = timed("read_reviews", lambda: commerce.reviews(spark, FOLDER), keep=True)
    titles = commerce.products(spark, FOLDER)
    vertices = timed(
        "graph_vertices",
        lambda: graph.user_vertices(raw).unionByName(graph.product_vertices(raw, titles)),
        keep=True,
    )
    edges = timed("graph_edges", lambda: graph.review_edges(graph.distinct_reviews(raw), "e"), keep=True)
    timed("degree_histogram", lambda: reports.degree_histogram(vertices))
    timed("number_rows", lambda: number_rows(edges.select("edge_id", "unix_review_time"), ["unix_review_time", "edge_id"], "n"))
    documents = commerce.table(spark, FOLDER, "documents")
    lexicon = stage(catalog.invented_lexicon(documents), "lexicon")
    timed("lexicon_sentiment", lambda: lexicon_sentiment(documents, "doc_id", "text", lexicon))
    scored = timed("review_score", lambda: scoring.review_score(edges), keep=True)
    enriched = timed("edges_with_degrees", lambda: graph.with_endpoint_degrees(scored, vertices), keep=True)
    belief_vertices, belief_edges = beliefs.init_beliefs(vertices, enriched)
    belief_edges = timed("init_beliefs", lambda: belief_edges, keep=True)
    settled = timed("lbp_run", lambda: beliefs.run_lbp(belief_edges, ROUNDS), keep=True)
    taken["lbp_iteration"] = round(taken["lbp_run"] / ROUNDS, 3)
    believed = timed("node_beliefs", lambda: beliefs.node_beliefs(belief_vertices, settled), keep=True)
    labelled = timed("fuse_review_labels", lambda: fusion.fuse_review_labels(believed, settled), keep=True)
    timed("review_label_distribution", lambda: reports.review_label_distribution(labelled, "honest"))
    timed("hits", lambda: hits.hits(vertices, edges, ROUNDS)[0])
    taken["hits_iteration"] = round(taken["hits"] / ROUNDS, 3)
    offers = stage(commerce.offer_reviews(spark, FOLDER).select("src", "dst"), "offers")
    ends = stage(graph.degrees(offers), "ends")
    found = timed("connected_components", lambda: components.connected_components(ends, offers), keep=True)
    timed("cross_component_edges", lambda: components.cross_component_edges(offers, found))
    accounts = stage(commerce.account_reviews(spark, FOLDER), "accounts")
    timed("cycle_core", lambda: components.cycle_core(graph.Graph(graph.degrees(accounts), accounts)))
    sparse = catalog.sparse_belief_edges(spark, FOLDER)
    timed("lbp_run_sparse", lambda: beliefs.run_lbp(sparse, ROUNDS))
    timed("boost_priors", lambda: beliefs.boost_priors(belief_vertices, belief_edges, graph.repeat_reviews(edges))[1])

    n = belief_edges.count()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(s for name, s in taken.items() if not name.endswith("_iteration")), 3),
                "unit": "sec",
                "queries": taken,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
                "edges": n,
                "lbp_edges_per_sec": round(n / taken["lbp_iteration"]),
                "cpus": CPUS,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
