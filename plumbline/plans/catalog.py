"""Every operator as a query over the given tables.

``reviews`` are customers reviewing parts, a dense graph; ``offers`` are one-off
accounts reviewing supplier offers, a sparse graph with once-seen endpoints and many
components (see :mod:`plumbline.sources.commerce`). All rows of the tables take part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.functions import messages as msg
from plumbline.operators import active, beliefs, components, fusion, graph, hits, merge, reports, sampling, scoring
from plumbline.operators.graph import Graph
from plumbline.operators.numbering import number_rows
from plumbline.operators.sentiment import lexicon_sentiment
from plumbline.plans.cutting import release_shuffles, scratch_path, stage, staging
from plumbline.sources import commerce
from plumbline.sources.snapshots import read_snapshots

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, Query] = {}

ITERATIONS = 2
QUARTER_DAYS = 90
CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def query(f: Query) -> Query:
    CATALOG[f.__name__] = f
    return f


def even(*columns: str) -> list[Column]:
    """Doubles at 6 places, so that the order of additions does not show."""
    return [(F.round(c, 6) + 0.0).alias(c) for c in columns]


# -- shared inputs -----------------------------------------------------------------


def _reviews(spark, folder, placed=False):
    return commerce.reviews(spark, folder, placed)


def _offers(spark, folder, placed=False):
    return commerce.offer_reviews(spark, folder, placed)


def _numbered(edges: DataFrame, *keep: str) -> DataFrame:
    """[_rank, src, dst, s, *keep] of the distinct edges; what else they hold is not carried into later joins."""
    order = _time_order(edges.drop(commerce.PLACE))
    scored = edges.withColumn("s", scoring.score())
    return number_rows(scored, order, "_rank", distinct=True, keep=["src", "dst", "s", *keep], place=commerce.PLACE, lead=3)


def _with_ids(numbered: DataFrame) -> DataFrame:
    """``edge_id`` in place of the rank, which is shorter and so goes through the shuffles before."""
    rest = [c for c in numbered.columns if c != "_rank"]
    return numbered.select(F.concat(F.lit("e"), F.col("_rank").cast("string")).alias("edge_id"), *rest)


def _scored(edges: DataFrame, *keep: str, s: str = "s") -> tuple[DataFrame, DataFrame]:
    """The degrees of the distinct edges, and these with ids, endpoint degrees and the score ``s``, as tables."""
    with staging(edges.sparkSession):
        numbered = _numbered(edges, *keep)
        release_shuffles(edges.sparkSession)
        heavy = graph.heavy_ends(numbered)
        enriched = graph.with_endpoint_degrees(numbered, heavy=heavy).withColumn("s", F.col(s)).drop(*keep)
        scored = stage(_with_ids(enriched), "belief-edges", True, "dst" if heavy["dst"] is None else None)
    release_shuffles(edges.sparkSession)
    return stage(graph.degrees(scored), "degrees", False, "id"), scored


def _time_order(df: DataFrame) -> list[str]:
    leading = ["unix_review_time", "src", "dst"]
    return leading + [c for c in df.columns if c not in leading]


def _belief_graph(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    return beliefs.init_beliefs(*_scored(edges))


def sparse_belief_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Belief edges of one-off accounts and offers, as a table."""
    return stage(_belief_graph(_offers(spark, folder, placed=True))[1], "sparse")


def _lbp(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    vertices, start = _belief_graph(edges)
    return vertices, beliefs.run_lbp(start, ITERATIONS, by_product=True)


def _labelled(edges: DataFrame) -> DataFrame:
    vertices, settled = _lbp(edges)
    return fusion.fuse_review_labels(beliefs.node_beliefs(vertices, settled), settled)


def _messages(edges: DataFrame) -> DataFrame:
    return edges.select("edge_id", "src", "dst", *even(*beliefs.MESSAGES))


def _offer_graph(spark, folder) -> Graph:
    edges = _offers(spark, folder)
    return Graph(graph.degrees(edges), edges.select("src", "dst"))


def invented_lexicon(documents: DataFrame) -> DataFrame:
    """[token, valence] for the documents' invented words, valence -4.0 .. 4.0 from their md5."""
    token = F.explode(F.split(F.lower("text"), "[^a-zà-ÿ]+"))
    number = F.conv(F.substring(F.md5("token"), 1, 6), 16, 10).cast("bigint")
    words = documents.select(token.alias("token")).where(F.length("token") > 1).distinct()
    return words.withColumn("valence", (number % 81 - 40) / 10).where("valence <> 0")


def _document_sentiment(spark, folder) -> DataFrame:
    documents = commerce.table(spark, folder, "documents")
    return lexicon_sentiment(documents, "doc_id", "text", stage(invented_lexicon(documents), "lexicon"))


# -- graph -------------------------------------------------------------------------


@query
def degree_histogram(spark, folder):
    return reports.degree_histogram(graph.degrees(_offers(spark, folder)))


def _listed_twice(spark, folder):
    """Reviews with a second copy of every unverified row, and titles with a second one for large parts."""
    rows = _reviews(spark, folder)
    part = commerce.table(spark, folder, "part").where("p_size > 25")
    asin = F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("asin")
    second = part.select(asin, F.concat_ws(" ", "p_brand", "p_name").alias("title"))
    return rows.union(rows.where(~F.col("verified"))), commerce.products(spark, folder).union(second)


@query
def graph_vertices(spark, folder):
    rows, titles = _listed_twice(spark, folder)
    return graph.build_graph(rows, titles, "e").vertices


@query
def graph_edges(spark, folder):
    rows, titles = _listed_twice(spark, folder)
    return graph.build_graph(rows, titles, "e").edges


@query
def edges_with_degrees(spark, folder):
    edges = _offers(spark, folder)
    return graph.with_endpoint_degrees(edges, graph.degrees(edges))


@query
def degree_flags_left(spark, folder):
    """Degrees come from verified reviews only, so some endpoints are unknown."""
    edges = _offers(spark, folder)
    return graph.with_degree_flags(edges, graph.degrees(edges.where("verified")))


@query
def shared_vertices(spark, folder):
    vertices = graph.degrees(_reviews(spark, folder))
    return graph.shared_vertices(vertices, "p", 20).select("id", *even("ratio"), "deg")


@query
def neighbours(spark, folder):
    edges = _offers(spark, folder)
    return graph.neighbours(edges.select("src", "dst", "unix_review_time"), graph.degrees(edges))


@query
def graph_problems(spark, folder):
    """Vertices are taken from verified reviews, those of users twice."""
    edges = _offers(spark, folder)
    known = graph.degrees(edges.where("verified"))
    return Graph(known.union(known.where("type = 'u'")), edges).problems()


# -- scores ------------------------------------------------------------------------


@query
def vote_rating_parse(spark, folder):
    return scoring.parse_fields(_reviews(spark, folder)).select("src", "dst", "unix_review_time", "vote", "votes", "overall", "rating_weight")


@query
def rejected_rows(spark, folder):
    """Ratings shifted by one star, so that a fifth is out of range; the votes of another fifth are words."""
    vote = F.when(F.col("overall") == 3, "many").otherwise(F.col("vote"))
    return scoring.rejected_rows(_reviews(spark, folder).withColumns({"vote": vote, "overall": F.col("overall") + 1}))


@query
def review_score(spark, folder):
    scored = scoring.review_score(_reviews(spark, folder))
    return scored.select("src", "dst", "unix_review_time", "vote", *even("s"))


@query
def review_score_text_tie(spark, folder):
    scored = scoring.review_score(_reviews(spark, folder), 1, 2, 0.02, tie="text")
    return scored.select("src", "dst", "unix_review_time", "vote", *even("s"))


@query
def lexicon_sentiment_documents(spark, folder):
    return _document_sentiment(spark, folder)


@query
def review_score_of_text(spark, folder):
    """From text to score: the sentiment of each review's document instead of the stand-in."""
    moods = _document_sentiment(spark, folder).select("doc_id", "compound")
    scored = scoring.review_score(_reviews(spark, folder).drop("compound").join(moods, "doc_id"))
    return scored.select("src", "dst", "unix_review_time", "vote", *even("s"))


@query
def repair_zero_compound(spark, folder):
    """Document sentiment as review sentiment: weak compounds count as 0, the weakest as wordless."""
    strength = F.abs(F.col("compound"))
    moods = _document_sentiment(spark, folder).withColumns(
        {
            "compound": F.when(strength < 0.8, 0.0).otherwise(F.col("compound")),
            **{c: F.when(strength < 0.4, 0.0).otherwise(F.col(c)) for c in ("pos", "neg")},
        }
    )
    rows = _reviews(spark, folder).select("src", "dst", "unix_review_time", "overall", "doc_id").join(moods, "doc_id")
    return scoring.repair_zero_compound(rows).select(
        "src", "dst", "unix_review_time", *even("neg", "neu", "pos", "compound", "pos_or_neg")
    )


# -- beliefs -----------------------------------------------------------------------


def _quarterly(edges: DataFrame) -> DataFrame:
    seconds = QUARTER_DAYS * 86400
    return edges.withColumn("unix_review_time", F.floor(F.col("unix_review_time") / seconds) * seconds)


@query
def repeat_reviews(spark, folder):
    return graph.repeat_reviews(_quarterly(_reviews(spark, folder)))


def _boosted(spark, folder):
    edges = _reviews(spark, folder, placed=True)
    vertices, start = _belief_graph(edges)
    return beliefs.boost_priors(vertices, start, graph.repeat_reviews(_quarterly(edges)))


@query
def boost_priors_vertices(spark, folder):
    return _boosted(spark, folder)[0]


@query
def boost_priors_edges(spark, folder):
    return _boosted(spark, folder)[1].select("edge_id", "src", "dst", *beliefs.PRIORS)


@query
def lbp_user_to_product(spark, folder):
    return _messages(beliefs.user_to_product(_belief_graph(_offers(spark, folder, placed=True))[1]))


@query
def lbp_product_to_user(spark, folder):
    """The half-step after one whole iteration."""
    _, start = _belief_graph(_offers(spark, folder, placed=True))
    return _messages(beliefs.product_to_user(beliefs.user_to_product(start)))


@query
def lbp_iterate(spark, folder):
    return _messages(_lbp(_reviews(spark, folder, placed=True))[1])


@query
def lbp_iterate_crowded(spark, folder):
    """The same as ``lbp_iterate`` with every vertex of more than 25 edges treated as heavy."""
    _, start = _belief_graph(_reviews(spark, folder, placed=True))
    return _messages(beliefs.run_lbp(start, ITERATIONS, group_limit=25))


@query
def lbp_iterate_sparse(spark, folder):
    return _messages(_lbp(_offers(spark, folder, placed=True))[1])


@query
def lbp_boosted(spark, folder):
    """One iteration with priors raised for repeated reviews."""
    return _messages(beliefs.run_lbp(_boosted(spark, folder)[1], 1))


@query
def lbp_sampled(spark, folder):
    _, start = _belief_graph(_reviews(spark, folder, placed=True))
    return _messages(beliefs.run_lbp(start, 1, sampling=beliefs.Sampling(max_deg=35, sample_size=15)))


@query
def lbp_sampled_exactly(spark, folder):
    """One iteration in which a vertex of 35 or more edges hears exactly 15 of them."""
    _, start = _belief_graph(_reviews(spark, folder, placed=True))
    return _messages(beliefs.run_lbp(start, 1, sampling=beliefs.Sampling(max_deg=35, sample_size=15, exact=True)))


@query
def bottom_k_sample(spark, folder):
    """The 15 edges that a vertex of 35 or more edges hears."""
    _, start = _belief_graph(_reviews(spark, folder, placed=True))
    users = sampling.bottom_k(start.where("u_deg >= 35"), "src", 15).select(F.col("src").alias("id"), "edge_id", "rank")
    products = sampling.bottom_k(start.where("p_deg >= 35"), "dst", 15).select(F.col("dst").alias("id"), "edge_id", "rank")
    return users.unionByName(products)


@query
def lbp_active(spark, folder):
    """The same as ``lbp_iterate_sparse``, only vertices whose evidence moved being recomputed."""
    _, start = _belief_graph(_offers(spark, folder, placed=True))
    return _messages(active.run_lbp_active(start, ITERATIONS)[0])


@query
def lbp_convergence(spark, folder):
    _, start = _belief_graph(_offers(spark, folder, placed=True))
    path = scratch_path(spark, "snapshots")
    beliefs.run_lbp(start, ITERATIONS, snapshot_dir=path)
    report = reports.convergence(read_snapshots(spark, path))
    return report.select("iteration", *even(*[c for c in report.columns if c != "iteration"]))


@query
def node_beliefs(spark, folder):
    return beliefs.node_beliefs(*_lbp(_offers(spark, folder, placed=True))).select("id", "type", "deg", *even(*beliefs.BELIEFS))


@query
def unscored_edges(spark, folder):
    """Scores of plain sentiment, where many are exactly 0."""
    return beliefs.unscored_edges(_reviews(spark, folder).withColumn("s", F.col("compound")))


@query
def constant_variables(spark, folder):
    edges = _offers(spark, folder).select("src", "dst", "unix_review_time")
    return beliefs.add_random_variable(edges, "trust", ["low", "high"], 0.5)


@query
def max_normalise(spark, folder):
    vertices = beliefs.max_normalise(graph.degrees(_reviews(spark, folder)), [("deg", "share")])
    return vertices.select("id", "type", "deg", *even("share"))


@query
def normalise_pairs(spark, folder):
    """Votes against stars as a pair that adds up to 10."""
    rows = scoring.parse_fields(_reviews(spark, folder))
    first, second = msg.normalise_pair(F.col("votes").cast("double"), F.col("overall").cast("double"), 10)
    pairs = rows.withColumns({"voted": first, "starred": second})
    return pairs.select("src", "dst", "unix_review_time", *even("voted", "starred"))


# -- labels and reports ------------------------------------------------------------


@query
def fuse_review_labels(spark, folder):
    return _labelled(_offers(spark, folder, placed=True)).select(
        "edge_id", "src", "dst",
        *even("fake", "genuine", "uncertainty"), "label",
    )


@query
def fuse_plain_sentiment(spark, folder):
    """Labels where the score is plain sentiment, so that many messages are never answered."""
    vertices, start = beliefs.init_beliefs(*_scored(_offers(spark, folder, placed=True), "compound", s="compound"))
    settled = beliefs.run_lbp(start, ITERATIONS, by_product=True)
    labelled = fusion.fuse_review_labels(beliefs.node_beliefs(vertices, settled), settled)
    return labelled.select("edge_id", *even("fake", "genuine", "uncertainty"), "label")


@query
def review_mass_map(spark, folder):
    """The rounded masses as one map, in readable form."""
    mapped = fusion.with_mass_map(_labelled(_offers(spark, folder, placed=True)))
    parts = [F.concat_ws("=", F.lit(k), (100 * F.col("masses")[k]).cast("decimal(9,0)").cast("string")) for k in ("fake", "genuine", "uncertainty")]
    return mapped.select("edge_id", F.concat_ws(" ", *parts).alias("masses"), F.size("masses").alias("entries"))


@query
def review_labels_dense(spark, folder):
    return reports.label_shares(_labelled(_reviews(spark, folder, placed=True))).select("label", "reviews", *even("share"))


@query
def review_label_distribution_by_honesty(spark, folder):
    return reports.review_label_distribution(_labelled(_offers(spark, folder, placed=True)), "honest")


@query
def review_label_distribution_by_badness(spark, folder):
    return reports.review_label_distribution(_labelled(_offers(spark, folder, placed=True)), "bad")


@query
def label_by_singleton(spark, folder):
    return reports.label_by_singleton(_labelled(_offers(spark, folder, placed=True)))


@query
def belief_histogram(spark, folder):
    """P(bad) per part type."""
    edges = _reviews(spark, folder, placed=True)
    vertices, settled = _lbp(edges)
    category = edges.select(F.col("dst").alias("id"), "category").distinct()
    return reports.belief_histogram(beliefs.node_beliefs(vertices, settled).join(category, "id"), "p_bad")


@query
def fraud_histogram(spark, folder):
    """P(fraud) per part type, a user counting in every type it reviewed."""
    edges = _offers(spark, folder, placed=True)
    vertices, settled = _lbp(edges)
    kinds = edges.groupBy(F.col("src").alias("id")).agg(F.collect_set("category").alias("categories"))
    believed = beliefs.node_beliefs(vertices, settled).join(kinds, "id")
    return reports.belief_histogram(believed.withColumn("category", F.explode("categories")), "p_fraud")


@query
def node_class_counts(spark, folder):
    return reports.node_class_counts(beliefs.node_beliefs(*_lbp(_offers(spark, folder, placed=True))))


# -- graph algorithms --------------------------------------------------------------


def _hits(spark, folder):
    edges = _reviews(spark, folder).select("src", "dst")
    return hits.hits(graph.degrees(edges).select("id"), edges, 3)


@query
def hits_hubs(spark, folder):
    return _hits(spark, folder)[0].select("id", *even("h_score"))


@query
def hits_authorities(spark, folder):
    return _hits(spark, folder)[1].select("id", *even("a_score"))


def _users_known(spark, folder):
    """HITS with only the users of verified reviews listed as vertices."""
    edges = _reviews(spark, folder)
    users = graph.degrees(edges.where("verified")).where("type = 'u'")
    return hits.hits(users.select("id"), edges.select("src", "dst"), 3, group_limit=40)


@query
def hits_hubs_of_unlisted(spark, folder):
    return _users_known(spark, folder)[0].select("id", *even("h_score"))


@query
def hits_authorities_of_unlisted(spark, folder):
    return _users_known(spark, folder)[1].select("id", *even("a_score"))


def _components(g: Graph) -> DataFrame:
    return components.connected_components(g.vertices, g.edges)


@query
def connected_components(spark, folder):
    return _components(_offer_graph(spark, folder))


@query
def cross_component_edges(spark, folder):
    """Reviews that link communities which verified reviews alone keep apart."""
    edges = _offers(spark, folder)
    verified = Graph(graph.degrees(edges), edges.where("verified").select("src", "dst"))
    return components.cross_component_edges(edges, stage(_components(verified), "components"))


def _account_pairs(spark, folder):
    """Accounts of neighbouring orders, some of which have no review, and accounts with what they reviewed."""
    order = commerce.table(spark, folder, "orders")
    account = [F.concat(F.lit("u"), (F.col("o_orderkey") + i).cast("string")) for i in (0, 1)]
    return order.select(account[0].alias("src"), account[1].alias("dst")).union(_offers(spark, folder).select("src", "dst"))


@query
def same_component_pairs(spark, folder):
    found = stage(_components(_offer_graph(spark, folder)), "components")
    return components.same_component(_account_pairs(spark, folder), found)


@query
def pairs_across_components(spark, folder):
    found = stage(_components(_offer_graph(spark, folder)), "components")
    return components.pairs_across_components(_account_pairs(spark, folder), found)


@query
def has_cycle(spark, folder):
    """Offers, where cycles are rare, and customers with parts, where they are not."""
    edges = _reviews(spark, folder)
    found = components.cycle_report(_offer_graph(spark, folder)).withColumn("graph", F.lit("offers"))
    dense = components.cycle_report(Graph(graph.degrees(edges), edges.select("src", "dst")))
    return found.unionByName(dense.withColumn("graph", F.lit("reviews")))


@query
def cycle_core(spark, folder):
    """Accounts and parts, where accounts with one review are dead ends."""
    edges = commerce.account_reviews(spark, folder)
    return components.cycle_core(Graph(graph.degrees(edges), edges))


# -- merging -----------------------------------------------------------------------


def _by_category(edges: DataFrame) -> tuple[list[tuple[DataFrame, str]], list[DataFrame]]:
    """A belief graph per part type; priors differ so that the merge order shows."""
    scored = stage(_with_ids(_numbered(edges, "category")), "scored")
    vertex_parts, edge_parts = [], []
    for i, name in enumerate(CATEGORIES):
        own = scored.where(F.col("category") == name)
        counted = stage(graph.degrees(own), "degrees")
        v, e = beliefs.init_beliefs(counted, graph.with_endpoint_degrees(own, counted), prior=2.0 + i)
        vertex_parts.append((v, name))
        edge_parts.append(e)
    return vertex_parts, edge_parts


@query
def merge_vertices(spark, folder):
    merged = merge.merge_vertices(_by_category(_reviews(spark, folder, placed=True))[0])
    return merged.withColumn("category", F.concat_ws(",", "category"))


@query
def merge_categories_vertices(spark, folder):
    return merge.merge_categories(*_by_category(_reviews(spark, folder, placed=True)))[0]


@query
def merge_categories_edges(spark, folder):
    edges = merge.merge_categories(*_by_category(_reviews(spark, folder, placed=True)))[1]
    return edges.select("edge_id", "src", "dst", "u_deg", "single_user", "p_deg", "single_product", "prior_fraud")


def _ids(edges: DataFrame, end: str) -> DataFrame:
    return edges.select(F.col(end).alias("id"))


@query
def union_all(spark, folder):
    edges = _offers(spark, folder)
    both = merge.union_all(_ids(edges, "src"), _ids(edges, "dst"))
    return both.groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query
def union_all_by_name(spark, folder):
    edges = _offers(spark, folder).select("src", "dst", "verified")
    parts = [edges.where("verified"), edges.where("not verified").select("verified", "dst", "src")]
    return merge.union_all_by_name(parts)


@query
def except_all(spark, folder):
    edges = _reviews(spark, folder).select("src", "category", "verified")
    pairs = [edges.where(c).select("src", "category") for c in ("verified", "not verified")]
    left = merge.except_all(*pairs)
    return left.groupBy("src", "category").agg(F.count(F.lit(1)).alias("n"))


@query
def intersect_ids(spark, folder):
    edges = _offers(spark, folder)
    return merge.intersect(_ids(edges.where("verified"), "dst"), _ids(edges.where("not verified"), "dst"))


@query
def except_ids(spark, folder):
    edges = _offers(spark, folder)
    return merge.except_ids(_ids(edges, "dst"), _ids(edges.where("verified"), "dst"))
