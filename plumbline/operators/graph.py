"""The bipartite review graph: building it, enriching it, looking around in it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from plumbline.operators.numbering import number_rows
from plumbline.plans.cutting import stage
from plumbline.plans.skew import GROUP_LIMIT, heavy_among, heavy_if_any, lookup_join


_ENDS = (("src", "u", "u_deg", "single_user"), ("dst", "p", "p_deg", "single_product"))


@dataclass(frozen=True)
class Graph:
    """Vertices (id, ...) and edges (src, dst, ...)."""

    vertices: DataFrame
    edges: DataFrame

    def __post_init__(self):
        for name, frame, needed in (
            ("vertices", self.vertices, {"id"}),
            ("edges", self.edges, {"src", "dst"}),
        ):
            missing = needed - set(frame.columns)
            if missing:
                raise ValueError(f"{name} lack column(s) {sorted(missing)}")

    def problems(self) -> DataFrame:
        """[problem, id]: vertex ids listed more than once and endpoints not listed."""
        keys = [c for c in ("id", "type") if c in self.vertices.columns]
        repeated = self.vertices.groupBy(*keys).count().where(F.col("count") > 1)
        ends = self.edges.select(F.col("src").alias("id")).union(self.edges.select("dst")).distinct()
        missing = ends.join(self.vertices.select("id").distinct(), "id", "left_anti")
        return repeated.select(F.lit("repeated id").alias("problem"), "id").union(
            missing.select(F.lit("unknown endpoint").alias("problem"), "id")
        )


def distinct_reviews(reviews: DataFrame) -> DataFrame:
    """Full-row distinct, staged because vertices and edges both start from it."""
    return stage(reviews.dropDuplicates(), "reviews")


def degrees(edges: DataFrame) -> DataFrame:
    """[id, type, deg]: reviews per user ('u') and per product ('p')."""

    def count(end: str, kind: str) -> DataFrame:
        return edges.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("deg")).select(
            "id", F.lit(kind).alias("type"), "deg"
        )

    return count("src", "u").unionByName(count("dst", "p"))


def user_vertices(reviews: DataFrame) -> DataFrame:
    """One row per reviewer with the name used first (the smaller one on equal times).

    ``several_name`` tells whether the user has more than one review row;
    ``n_distinct_names`` counts the names really used.
    """
    names = reviews.groupBy(F.col("src").alias("id"), F.col("reviewer_name").alias("used")).agg(
        F.count(F.lit(1)).alias("uses"), F.min("unix_review_time").alias("first_use")
    )
    return names.groupBy("id").agg(
        F.sum("uses").alias("deg"),
        F.min_by("used", F.struct(F.col("used").isNull(), "first_use", "used")).alias("name"),
        F.count("used").alias("n_distinct_names"),
    ).select(
        "id", "deg", F.lit("u").alias("type"), "name",
        (F.col("deg") > 1).alias("several_name"), "n_distinct_names",
    )


def product_vertices(reviews: DataFrame, products: DataFrame) -> DataFrame:
    """One row per reviewed product with its smallest title, '' if it has none."""
    titles = (
        products.select("asin", "title").distinct()
        .groupBy("asin")
        .agg(
            F.min("title").alias("title"),
            F.count(F.lit(1)).alias("listings"),
            F.count("title").alias("n_titles"),
        )
    )
    counted = reviews.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("deg"))
    return counted.join(titles, F.col("id") == F.col("asin"), "left").select(
        "id", "deg", F.lit("p").alias("type"),
        F.coalesce("title", F.lit("")).alias("name"),
        F.coalesce(F.col("listings") > 1, F.lit(False)).alias("several_name"),
        F.coalesce("n_titles", F.lit(0)).cast("bigint").alias("n_distinct_names"),
    )


def review_edges(reviews: DataFrame, edge_label: str) -> DataFrame:
    """Reviews as edges, ``edge_id`` = label followed by the rank in review time."""
    edges = reviews.drop("reviewer_name")
    leading = ["unix_review_time", "src", "dst"]
    texts = [c for c in edges.columns if c in ("summary", "review_text")]
    order = leading + [c for c in edges.columns if c not in leading + texts]
    if texts:
        # range bounds are sampled to the driver, so long texts only enter as a hash
        order.append(F.xxhash64(*texts))
    numbered = number_rows(edges, order, "_rank")
    return numbered.select(
        F.concat(F.lit(edge_label), F.col("_rank").cast("string")).alias("edge_id"), *edges.columns
    )


def build_graph(reviews: DataFrame, products: DataFrame, edge_label: str) -> Graph:
    """Graph of users, products and reviews from raw review and product rows."""
    clean = distinct_reviews(reviews)
    vertices = user_vertices(clean).unionByName(product_vertices(clean, products))
    return Graph(vertices, review_edges(clean, edge_label))


def with_endpoint_degrees(
    edges: DataFrame, vertices: DataFrame | None = None, limit: int = GROUP_LIMIT, heavy: dict[str, DataFrame | None] | None = None
) -> DataFrame:
    """Add ``u_deg``, ``single_user``, ``p_deg`` and ``single_product`` from vertex degrees.

    An edge whose user or product is not among the vertices is left out. Without ``vertices``
    the degrees are those of the edges themselves, counted where the edges of a vertex meet;
    ``heavy`` is then what :func:`heavy_ends` found, if it is known already.
    """
    if vertices is None:
        heavy = heavy_ends(edges, limit) if heavy is None else heavy
        for end, kind, deg, single in _ENDS:
            if heavy[end] is None:
                known = F.count(F.lit(1)).over(Window.partitionBy(end))
                edges = edges.where(F.col(end).isNotNull()).withColumn(deg, known)
            else:
                counts = edges.where(F.col(end).isNotNull()).groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias(deg))
                edges = lookup_join(edges, counts, end, "id", heavy=heavy[end])
            edges = edges.withColumn(single, F.col(deg) == 1)
        return edges
    heavy = heavy_vertices(vertices, limit)
    for end, kind, deg, single in _ENDS:
        known = vertices.where(F.col("type") == kind).select("id", F.col("deg").alias(deg))
        edges = lookup_join(edges, known, end, "id", heavy=heavy[kind]).withColumn(single, F.col(deg) == 1)
    return edges


def heavy_vertices(vertices: DataFrame, limit: int = GROUP_LIMIT) -> dict[str, DataFrame | None]:
    """Heavy users ('u') and products ('p') for joins by vertex, by their recorded degree."""
    tops = vertices.groupBy("type").agg(F.max("deg").alias("top")).collect()  # one row per type
    found = {row["type"] for row in tops if row["top"] > limit}
    return {
        kind: heavy_among(vertices.where(F.col("type") == kind), "id", "deg", limit) if kind in found else None
        for kind in ("u", "p")
    }


def mostly_single_products(vertices: DataFrame) -> bool:
    """Whether more than half of all edges end at products that occur once, by the recorded degrees."""
    single = F.count_if(F.col("deg") == 1)
    found = vertices.where(F.col("type") == "p").agg(single.alias("single"), F.sum("deg").alias("edges")).first()
    return 2 * found["single"] > (found["edges"] or 0)


def heavy_ends(edges: DataFrame, limit: int = GROUP_LIMIT) -> dict[str, DataFrame | None]:
    """Heavy ids at ``src`` and ``dst``, each counted once and kept."""
    return {end: heavy_if_any(edges, end, limit) for end in ("src", "dst")}


def with_degree_flags(edges: DataFrame, vertices: DataFrame, limit: int = GROUP_LIMIT) -> DataFrame:
    """Like :func:`with_endpoint_degrees`, but an unknown endpoint counts as degree 1."""
    heavy = heavy_ends(edges, limit)
    for end, kind, deg, single in _ENDS:
        shared = shared_vertices(vertices, kind).select("id", F.col("deg").alias(deg))
        edges = (
            lookup_join(edges, shared, end, "id", how="left", heavy=heavy[end])
            .withColumn(single, F.col(deg).isNull())
            .withColumn(deg, F.coalesce(deg, F.lit(1)))
        )
    return edges


def shared_vertices(vertices: DataFrame, kind: str, sample_size: int = 500) -> DataFrame:
    """[id, ratio, deg] of the vertices of one kind with more than one edge.

    ``ratio`` is the share of its edges that makes up a sample of ``sample_size``.
    """
    return vertices.where((F.col("type") == kind) & (F.col("deg") > 1)).select(
        "id", F.least(F.lit(float(sample_size)) / F.col("deg"), F.lit(1.0)).alias("ratio"), "deg"
    )


def repeat_reviews(edges: DataFrame) -> DataFrame:
    """[src, dst, unix_review_time, count] for reviews posted more than once at one time."""
    return edges.groupBy("src", "dst", "unix_review_time").count().where(F.col("count") > 1)


def neighbours(edges: DataFrame, ids: DataFrame, limit: int = GROUP_LIMIT) -> DataFrame:
    """Edges touching any of ``ids`` [id] with ``id`` and the ``neighbour`` at the other end."""
    forward = edges.select(F.col("src").alias("id"), F.col("dst").alias("neighbour"), "*")
    backward = edges.where(F.col("src") != F.col("dst")).select(
        F.col("dst").alias("id"), F.col("src").alias("neighbour"), "*"
    )
    both = forward.unionByName(backward)
    return lookup_join(both, ids.select(F.col("id").alias("wanted")).distinct(), "id", "wanted", limit=limit)
