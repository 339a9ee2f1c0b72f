"""Loopy belief propagation over the review graph.

Every edge carries the message arriving at its user (``mu_fraud``, ``mu_honest``)
and at its product (``mp_bad``, ``mp_good``). One iteration sends user to product,
then product to user with the fresh messages.

A half-step needs, per vertex, the sum of the messages' log-odds. Edges are
shuffled once by that vertex and summed in place with a window, so a chain of
iterations is a straight line of shuffles and nothing is computed twice. A vertex
with more than ``group_limit`` edges never enters a window: its sum is
pre-aggregated, and the short list of such sums is broadcast to its edges, which
stay where they are. While no user has heard anything all their sums are 0, so the first
half-step of a neutral start needs no shuffle. A message that is about to be replaced is
not shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions import messages as msg
from plumbline.operators.graph import heavy_ends
from plumbline.operators.sampling import hash_position, mark_bottom_k
from plumbline.plans.cutting import cut, release_shuffles, stage, together_by_one_key
from plumbline.plans.skew import GROUP_LIMIT, add_group_sum, lookup_join
from plumbline.sources.snapshots import read_snapshot, write_snapshot

USER_PRIORS = ["prior_fraud", "prior_honest"]
PRODUCT_PRIORS = ["prior_bad", "prior_good"]
PRIORS = USER_PRIORS + PRODUCT_PRIORS
USER_MESSAGES = ["mu_fraud", "mu_honest"]
PRODUCT_MESSAGES = ["mp_bad", "mp_good"]
MESSAGES = USER_MESSAGES + PRODUCT_MESSAGES
BELIEFS = ["p_fraud", "p_honest", "p_bad", "p_good"]
_STATE = ["_mu", "_mu_total", "_mp", "_mp_total"]


@dataclass(frozen=True)
class Sampling:
    """Opt-in: a vertex with ``max_deg`` or more edges hears only ``sample_size`` of them.

    An edge is kept when the hash of its id falls below ``sample_size / degree``, which
    gives about that many, or with ``exact`` when it is among the ``sample_size`` smallest of
    its vertex. Either way the same edges are kept in every iteration and on every run.
    """

    max_deg: int = 1000
    sample_size: int = 500
    exact: bool = False

    def prepare(self, edges: DataFrame, limit: int = GROUP_LIMIT) -> DataFrame:
        """``edges`` with what :meth:`keeps` looks at; an exact sample is taken here."""
        if self.exact:
            for key, degree in (("src", "u_deg"), ("dst", "p_deg")):
                edges = mark_bottom_k(edges, key, degree, self.max_deg, self.sample_size, f"_kept_{degree}", limit=limit)
        return edges

    def keeps(self, degree: str) -> Column:
        """Whether the side with that degree column hears an edge."""
        if self.exact:
            return F.col(f"_kept_{degree}")
        return (F.col(degree) < self.max_deg) | (hash_position() < F.lit(float(self.sample_size)) / F.col(degree))


@dataclass(frozen=True)
class _Side:
    """One sending side: what it groups by, what it hears and what it sends."""

    key: str
    degree: str
    single: str
    priors: list[str]
    heard: str
    sent: str
    sent_total: str
    send: Callable[[Column, Column], Column]


_USERS = _Side("src", "u_deg", "single_user", USER_PRIORS, "_mu", "_mp", "_mp_total", msg.message_to_product)
_PRODUCTS = _Side("dst", "p_deg", "single_product", PRODUCT_PRIORS, "_mp", "_mu", "_mu_total", msg.message_to_user)


def add_random_variable(df: DataFrame, name: str, values: list[str], default: float) -> DataFrame:
    """One constant column ``name=value`` per value of a variable."""
    return df.withColumns({f"{name}={value}": F.lit(float(default)) for value in values})


def max_normalise(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """For each (column, alias), ``alias`` = column / its maximum; null if that is 0."""
    highest = {alias: df.select(F.max(column).alias("m")).scalar() for column, alias in columns}
    return df.withColumns(
        {alias: F.try_divide(F.col(column), highest[alias]) for column, alias in columns}
    )


def init_beliefs(
    vertices: DataFrame,
    edges: DataFrame,
    prior: float = 2.0,
    carry: tuple[str, ...] = (),
    limit: int = GROUP_LIMIT,
) -> tuple[DataFrame, DataFrame]:
    """Belief vertices and belief edges with neutral messages.

    Priors are constant unless ``vertices`` already have prior columns, which are
    then copied to their edges. ``carry`` names further edge columns to keep.
    """
    known = [c for c in PRIORS if c in vertices.columns]
    constants = {c: F.lit(float(prior)) for c in PRIORS if c not in known}
    v = vertices.select("id", "type", "deg", *known).withColumns(constants).select("id", "type", "deg", *PRIORS)
    e = edges.select(
        "edge_id", "src", "dst", "single_user", "u_deg", "single_product", "p_deg", F.col("s").cast("double"), *carry
    )
    heavy = heavy_ends(edges, limit) if known else {}
    for end, kind, names in (("src", "u", USER_PRIORS), ("dst", "p", PRODUCT_PRIORS)):
        own = [c for c in names if c in known]
        if own:
            e = lookup_join(e, v.where(F.col("type") == kind).select("id", *own), end, "id", heavy=heavy[end])
    e = e.withColumns(constants).withColumns({c: F.lit(1.0) for c in MESSAGES})
    base = [c for c in e.columns if c not in PRIORS + MESSAGES]
    return v, e.select(*base, *PRIORS, *MESSAGES)


def boost_priors(
    vertices: DataFrame, edges: DataFrame, repeats: DataFrame, limit: int = GROUP_LIMIT
) -> tuple[DataFrame, DataFrame]:
    """Raise fraud and bad priors where one user reviewed one product repeatedly.

    ``repeats`` is [src, dst, ..., count]. An edge's ``prior_fraud`` and ``prior_bad``
    are multiplied by the counts of its (src, dst); a user's ``prior_fraud`` by all
    of that user's counts.
    """
    by_pair = repeats.groupBy(F.struct("src", "dst").alias("pair")).agg(F.product("count").alias("factor"))
    by_user = repeats.groupBy(F.col("src").alias("user")).agg(F.product("count").alias("factor"))
    factor = F.coalesce("factor", F.lit(1.0))
    e = lookup_join(edges.withColumn("_pair", F.struct("src", "dst")), by_pair, "_pair", "pair", "left", limit)
    e = e.withColumns({c: F.col(c) * factor for c in ("prior_fraud", "prior_bad")}).select(edges.columns)
    v = vertices.join(
        by_user.withColumn("kind", F.lit("u")), (F.col("id") == F.col("user")) & (F.col("type") == F.col("kind")), "left"
    )
    return v.withColumn("prior_fraud", F.col("prior_fraud") * factor).select(vertices.columns), e


def user_to_product(
    edges: DataFrame, sign_mag_effect: bool = True, sampling: Sampling | None = None, group_limit: int = GROUP_LIMIT
) -> DataFrame:
    """New messages at the products, from all users with more than one review."""
    return _single_half_step(edges, _USERS, sign_mag_effect, sampling, group_limit)


def product_to_user(
    edges: DataFrame, sign_mag_effect: bool = True, sampling: Sampling | None = None, group_limit: int = GROUP_LIMIT
) -> DataFrame:
    """New messages at the users, from all products with more than one review."""
    return _single_half_step(edges, _PRODUCTS, sign_mag_effect, sampling, group_limit)


def run_lbp(
    edges: DataFrame,
    iterations: int,
    start: int = 1,
    sign_mag_effect: bool = True,
    sampling: Sampling | None = None,
    snapshot_dir: str | None = None,
    cut_every: int = 5,
    group_limit: int = GROUP_LIMIT,
    by_product: bool = False,
) -> DataFrame:
    """Belief edges after ``iterations`` rounds, numbered from ``start``.

    ``edges`` is read up to three times, so it should be a table rather than a long plan.

    With ``snapshot_dir`` every round is written there (one ``iteration=N`` folder
    each) and the next one starts from the written table. To resume, pass the edges
    of the last snapshot and the next number as ``start``.

    Without snapshots only edges with two shared endpoints take part in all rounds
    but the last: what a once-seen user or product sends never changes and what it
    hears is sent on by nobody, so one full round at the end completes the rest.

    ``by_product`` tells that ``edges`` is a table staged by ``dst`` and that ``edge_id`` is
    unique. What the rounds do not need then stays there and meets the messages at the end.
    """
    if iterations < 1:
        return edges
    columns = edges.columns
    state = _compact(_sampled(edges, sampling, group_limit))
    lone_user, lone_product = (F.coalesce(c, F.lit(False)) for c in ("single_user", "single_product"))
    outer = lone_user | lone_product
    facts = state.agg(
        F.max("u_deg").alias("u_deg"),
        F.max("p_deg").alias("p_deg"),
        F.bool_or((F.col("single_user") & (F.col("_mp") != 0)) | (F.col("single_product") & (F.col("_mu") != 0))).alias("biased"),
        F.bool_or(_heard(_USERS, sampling) != 0).alias("heard"),
        F.count(F.lit(1)).alias("edges"),
        *[F.struct(F.min(c), F.max(c), F.count(c)).alias(c) for c in PRIORS],
        F.count_if(outer).alias("outer"),
        F.count_if(lone_product).alias("single_product"),
    ).first()
    heavy = {
        "u_deg": (facts["u_deg"] or 0) > group_limit,
        "p_deg": (facts["p_deg"] or 0) > group_limit,
    }
    # most edges end at once-seen products, which send nothing: those stay where the users' half-step left them
    apart = 2 * facts["single_product"] > facts["edges"]

    # priors that are the same everywhere are no part of the state
    uniform = {
        c: F.lit(low).cast(edges.schema[c].dataType)
        for c, (low, high, known) in ((c, facts[c]) for c in PRIORS)
        if low == high and known == facts["edges"]
    }
    state = state.drop(*uniform)

    def half_step(frame: DataFrame, side: _Side, silent: bool = False) -> DataFrame:
        known = {c: uniform[c] for c in side.priors if c in uniform}
        return _half_step(frame.withColumns(known), side, sign_mag_effect, sampling, group_limit, heavy[side.degree], silent).drop(*known)

    def settled(frame: DataFrame, key: str | None) -> DataFrame:
        """The state as a table, far smaller than a checkpoint; messages are expanded as it is read."""
        kept = [c for c in columns if c not in MESSAGES and c not in uniform]
        written = stage(frame.select(*kept, *_STATE), "settled", False, key)
        release_shuffles(edges.sparkSession)
        return _expand(written.withColumns(uniform), columns)

    def iterate(frame: DataFrame, first: bool) -> DataFrame:
        return half_step(half_step(frame, _USERS, first and not facts["heard"]), _PRODUCTS)

    def products_apart(frame: DataFrame) -> DataFrame:
        return half_step(frame.where(~lone_product), _PRODUCTS).unionByName(frame.where(lone_product))

    if snapshot_dir is not None:
        for i in range(start, start + iterations):
            heard = half_step(state, _USERS, i == start and not facts["heard"])
            stepped = products_apart(heard) if apart else half_step(heard, _PRODUCTS)
            write_snapshot(_expand(stepped.withColumns(uniform), columns), snapshot_dir, i)
            release_shuffles(edges.sparkSession)
            written = read_snapshot(edges.sparkSession, snapshot_dir, i, edges.schema)
            state = _compact(_sampled(written, sampling, group_limit)).drop(*uniform)
        return written

    # few such edges are not worth a second way through the plan
    if facts["biased"] or 8 * facts["outer"] < facts["edges"]:
        early, late = state, None
    else:
        early, late = state.where(~outer), state.where(outer)
    lean = by_product and late is None and sampling is None and not any(heavy.values())
    if lean:
        needed = ["single_user", "single_product", *[c for c in PRIORS if c not in uniform], *_STATE]
        early = early.select("edge_id", "src", "dst", F.signum("s").alias("s"), *needed)
    for i in range(1, iterations):
        early = iterate(early, i == 1)
        if i % cut_every == 0:
            early = cut(early)
    place = None if heavy["p_deg"] else "dst"
    silent = iterations == 1 and not facts["heard"]
    if late is None:
        early = half_step(half_step(early, _USERS, silent), _PRODUCTS)
        if not lean:
            return settled(early, place)
        rest = edges.drop(*MESSAGES, *uniform)
        found = early.select(F.col("edge_id").alias("_id"), F.col("dst").alias("_dst"), *_STATE)
        same = (F.col("dst") == F.col("_dst")) & (F.col("edge_id") == F.col("_id"))
        with together_by_one_key(edges.sparkSession):
            return settled(rest.join(found, same), place)
    # an edge of a once-seen user needs no users' half-step, one of a once-seen product no products' one
    told = half_step(early.unionByName(late.where(~lone_user)), _USERS, silent)
    untold = late.where(lone_user)
    if not apart:
        return settled(half_step(told.unionByName(untold), _PRODUCTS), place)
    # the rest lies by user after its half-step, and so does the table
    inner = told.where(~lone_product).unionByName(untold.where(~lone_product))
    stepped = half_step(inner, _PRODUCTS).unionByName(untold.where(lone_product))
    if heavy["u_deg"]:
        return settled(stepped.unionByName(told.where(lone_product)), None)
    buckets = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settled(told.where(lone_product).unionByName(stepped.repartition(buckets, "src")), "src")


def node_beliefs(vertices: DataFrame, edges: DataFrame, sampling: Sampling | None = None) -> DataFrame:
    """Vertices with ``p_fraud``/``p_honest`` for users and ``p_bad``/``p_good`` for products.

    A vertex with a single review has no belief of its own (null).
    """

    edges = _sampled(edges, sampling, GROUP_LIMIT)

    def heard(side: _Side, pair: list[str]) -> DataFrame:
        rows = edges.where(~F.col(side.single))
        if sampling is not None:
            rows = rows.where(sampling.keeps(side.degree))
        return rows.groupBy(F.col(side.key).alias("of")).agg(
            F.sum(msg.log_odds(F.col(pair[0]), F.col(pair[1]))).alias("evidence")
        )

    bare = vertices.drop(*BELIEFS)
    user = msg.log_odds(F.col("prior_fraud"), F.col("prior_honest")) + F.col("evidence")
    product = msg.log_odds(F.col("prior_bad"), F.col("prior_good")) + F.col("evidence")
    unknown = F.lit(None).cast("double")

    def believed(kind: str, evidence: DataFrame, odds: Column) -> DataFrame:
        """The type is a constant, so who asks for one kind computes one; joined by id only, rows stay by id."""
        own = bare.where(F.col("type") == kind).join(evidence, F.col("id") == F.col("of"), "left")
        shares = [msg.first_share(odds), msg.second_share(odds)]
        pairs = [*shares, unknown, unknown] if kind == "u" else [unknown, unknown, *shares]
        return own.select(
            *[F.lit(kind).alias(c) if c == "type" else F.col(c) for c in bare.columns],
            *[F.when(F.col("of").isNotNull(), share).alias(name) for share, name in zip(pairs, BELIEFS)],
        )

    both = believed("u", heard(_USERS, USER_MESSAGES), user).unionByName(
        believed("p", heard(_PRODUCTS, PRODUCT_MESSAGES), product)
    )
    others = bare.where(~F.coalesce(F.col("type").isin("u", "p"), F.lit(False)))
    if others.isEmpty():
        return both
    return both.unionByName(others.select("*", *[unknown.alias(name) for name in BELIEFS]))


def unscored_counts() -> dict[str, Column]:
    """Aggregates: edges whose score is null or 0 and therefore send nothing new."""
    return {"null_score": F.count_if(F.col("s").isNull()), "zero_score": F.count_if(F.col("s") == 0)}


def unscored_edges(edges: DataFrame) -> DataFrame:
    """One row of :func:`unscored_counts`."""
    return edges.agg(*[count.alias(name) for name, count in unscored_counts().items()])


def _single_half_step(edges, side, sign_mag_effect, sampling, group_limit):
    state = _compact(_sampled(edges, sampling, group_limit))
    top = state.agg(F.max(side.degree)).first()[0] or 0
    stepped = _half_step(state, side, sign_mag_effect, sampling, group_limit, top > group_limit)
    return _expand(stepped, edges.columns)


def _sampled(edges: DataFrame, sampling: Sampling | None, limit: int) -> DataFrame:
    return edges if sampling is None else sampling.prepare(edges, limit)


def _heard(side: _Side, sampling: Sampling | None) -> Column:
    """What an edge adds to the evidence of its vertex."""
    heard = F.when(F.col(side.single), 0.0).otherwise(F.coalesce(F.col(side.heard), F.lit(0.0)))
    return heard if sampling is None else F.when(sampling.keeps(side.degree), heard).otherwise(0.0)


def _half_step(state, side, sign_mag_effect, sampling, group_limit, heavy, silent=False):
    """``silent``: it is known that no vertex of this side has heard anything yet."""
    heard = _heard(side, sampling)

    # weighting both values by |s| cancels in normalisation; only s = 0 differs
    sends = ~F.col(side.single) & F.col("s").isNotNull()
    if sign_mag_effect:
        sends = sends & (F.col("s") != 0)
    if silent:
        summed = state.withColumn("_sum", F.lit(0.0))
    else:
        # what is replaced is not shuffled
        kept = {c: F.when(~F.coalesce(sends, F.lit(False)), F.col(c)) for c in (side.sent, side.sent_total)}
        crowded = F.col(side.degree) > group_limit if heavy else None
        # columns that differ from row to row lie side by side, which compresses better
        rest = [c for c in state.columns if c not in ("s", side.heard)]
        summed = add_group_sum(state.withColumns(kept).select(*rest, "s", side.heard), side.key, heard, "_sum", crowded)
    prior = msg.log_odds(F.col(side.priors[0]), F.col(side.priors[1]))
    fresh = side.send(F.col("_cavity"), F.col("s"))
    return (
        summed.withColumn("_cavity", prior + F.col("_sum") - heard)
        .withColumns(
            {
                side.sent: F.when(sends, fresh).otherwise(F.col(side.sent)),
                side.sent_total: F.when(sends, 1.0).otherwise(F.col(side.sent_total)),
            }
        )
        .drop("_cavity", "_sum")
    )


def _compact(edges: DataFrame) -> DataFrame:
    """Message pairs as log-odds and total."""
    c = F.col
    return edges.withColumns(
        {
            "_mu": msg.log_odds(c("mu_fraud"), c("mu_honest")),
            "_mu_total": c("mu_fraud") + c("mu_honest"),
            "_mp": msg.log_odds(c("mp_bad"), c("mp_good")),
            "_mp_total": c("mp_bad") + c("mp_good"),
        }
    ).drop(*MESSAGES)


def _expand(state: DataFrame, columns: list[str]) -> DataFrame:
    c = F.col
    return state.withColumns(
        {
            "mu_fraud": c("_mu_total") * msg.first_share(c("_mu")),
            "mu_honest": c("_mu_total") * msg.second_share(c("_mu")),
            "mp_bad": c("_mp_total") * msg.first_share(c("_mp")),
            "mp_good": c("_mp_total") * msg.second_share(c("_mp")),
        }
    ).select(*columns)
