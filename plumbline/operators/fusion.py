"""Labelling reviews by fusing the beliefs about their two endpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions import masses
from plumbline.operators.graph import heavy_vertices, mostly_single_products
from plumbline.plans.skew import GROUP_LIMIT, lookup_join

_DIGITS = 4
_MASSES = ("fake", "genuine", "uncertainty")

# per kind of vertex: evidence, the messages that stand in for it, the beliefs it comes from
_PAIRS = {
    "u": (["fraudster", "honest"], ["mu_fraud", "mu_honest"], ["p_fraud", "p_honest"]),
    "p": (["bad", "good"], ["mp_bad", "mp_good"], ["p_bad", "p_good"]),
}
_WORD, _BESIDE = "_word", "_beside"


def endpoint_evidence(
    vertices: DataFrame, edges: DataFrame, carry: tuple[str, ...] = (), limit: int = GROUP_LIMIT
) -> DataFrame:
    """Edges with ``fraudster``, ``honest``, ``bad``, ``good``, rounded to 4 places.

    An endpoint without a belief lends the message that reached it over this edge, as
    a pair that adds up to 1: one that was never updated is still (1, 1) and says
    nothing for either side.
    """
    heavy = heavy_vertices(vertices, limit)
    e = edges.select("edge_id", "src", "dst", "u_deg", "p_deg", "s", *_PAIRS["u"][1], *_PAIRS["p"][1], *carry)
    e = e.withColumns({c: F.round(c, _DIGITS) for c in ("s", *_PAIRS["u"][1], *_PAIRS["p"][1])})
    # settled edges lie by product, or by user if most products occur once (see run_lbp): that end is joined first
    ends = [("src", "u"), ("dst", "p")] if mostly_single_products(vertices) else [("dst", "p"), ("src", "u")]
    (_, first), (_, second) = ends
    for end, kind in ends:
        if kind == second:  # four numbers in one word while the edges are shuffled
            e = _packed(e, _PAIRS[first][0] + _PAIRS[second][1])
        own, messages, beliefs = _PAIRS[kind]
        known = vertices.where(F.col("type") == kind).select("id", *[F.col(b).alias(o) for b, o in zip(beliefs, own)])
        e = lookup_join(e, known, end, "id", spread=["edge_id"], heavy=heavy[kind])
        if kind == second:
            e = _unpacked(e, _PAIRS[first][0] + messages)
        total = F.col(messages[0]) + F.col(messages[1])
        e = e.withColumns({o: F.coalesce(F.round(o, _DIGITS), F.try_divide(m, total)) for o, m in zip(own, messages)})
    return e.select(
        "edge_id", "src", "dst", "u_deg", "p_deg", "s", *_PAIRS["u"][1], *_PAIRS["p"][1], *carry, *_PAIRS["u"][0], *_PAIRS["p"][0]
    )


def _packed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Four columns of at most 4 places as one word; values that do not fit 0 .. 3.2767 stay beside it."""
    scale = F.lit(float(10**_DIGITS))
    fits, word = F.lit(True), F.lit(0).cast("bigint")
    for c in columns:
        fits = fits & F.col(c).between(0.0, 3.2767) & (F.round(c, _DIGITS) == F.col(c))
        word = F.shiftleft(word, 16).bitwiseOR(F.round(F.col(c) * scale).cast("bigint"))
    fits = F.coalesce(fits, F.lit(False))
    rest = [c for c in rows.columns if c not in columns]
    return rows.select(F.when(~fits, F.array(*columns)).alias(_BESIDE), *rest, F.when(fits, word).alias(_WORD))


def _unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    values = {}
    for i, c in enumerate(columns):
        units = F.shiftright(_WORD, 16 * (len(columns) - 1 - i)).bitwiseAND(F.lit(0xFFFF))
        values[c] = F.when(F.col(_WORD).isNull(), F.col(_BESIDE)[i]).otherwise(units / F.lit(float(10**_DIGITS)))
    return rows.withColumns(values).drop(_WORD, _BESIDE)


def fuse_review_labels(
    vertices: DataFrame, edges: DataFrame, carry: tuple[str, ...] = (), limit: int = GROUP_LIMIT
) -> DataFrame:
    """Edges with the unrounded masses ``fake``, ``genuine``, ``uncertainty`` and the ``label``.

    The label is decided on masses rounded to 2 places, in whole hundredths.
    """
    evidence = endpoint_evidence(vertices, edges, carry, limit)
    c = F.col
    fused = masses.fuse(c("u_deg"), c("p_deg"), c("fraudster"), c("honest"), c("bad"), c("good"), c("s"))
    hundredths = [masses.in_units(F.col(m)) for m in _MASSES]
    return evidence.withColumns(fused).withColumn("label", masses.decide(*hundredths))


def rounded_masses(digits: int = 2) -> list[Column]:
    """The mass columns as labels see them."""
    return [(masses.in_units(F.col(m), digits) / F.lit(float(10**digits))).alias(m) for m in _MASSES]


def with_mass_map(labelled: DataFrame, column: str = "masses", digits: int = 2) -> DataFrame:
    """Add the rounded masses as one map<string,double>."""
    return labelled.withColumn(column, masses.as_map(*rounded_masses(digits)))


def unlabelled_counts() -> dict[str, Column]:
    """Aggregates: edges read and edges whose masses could not be fused."""
    return {"edges": F.count(F.lit(1)), "unlabelled": F.count_if(F.col("fake").isNull())}


def unlabelled_edges(labelled: DataFrame) -> DataFrame:
    """One row of :func:`unlabelled_counts`."""
    return labelled.agg(*[count.alias(name) for name, count in unlabelled_counts().items()])
