import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions.messages import NEGATIVE, POSITIVE
from plumbline.operators import active, beliefs, fusion, graph, reports, sampling
from plumbline.plans import skew
from plumbline.plans.cutting import cut, stage
from plumbline.sources.snapshots import last_iteration, read_snapshot, read_snapshots


def belief_graph(spark, rows, prior=2.0):
    """rows: (src, dst, s)."""
    df = spark.createDataFrame([(f"e{i}", *r) for i, r in enumerate(rows)], "edge_id string, src string, dst string, s double")
    vertices = graph.degrees(df)
    return beliefs.init_beliefs(vertices, graph.with_endpoint_degrees(df, vertices), prior)


def rows_of(df, *columns):
    return {r.edge_id: [r[c] for c in columns] for r in df.collect()}


def close(a, b, tolerance=1e-9):
    assert a.keys() == b.keys()
    for key in a:
        assert a[key] == pytest.approx(b[key], abs=tolerance), key


@pytest.fixture(scope="module")
def crowd(spark):
    """A random multigraph with two hot users and two hot products."""
    pick = random.Random(7)
    rows = [
        (f"u{pick.choice([0, 0, 1, pick.randrange(60)])}", f"p{pick.choice([0, 1, pick.randrange(60)])}", pick.choice([-0.6, 0.0, 0.4, 0.9]))
        for _ in range(400)
    ]
    return belief_graph(spark, rows)


def test_worked_example(spark):
    _, start = belief_graph(
        spark, [("u2", "p1", 1.0), ("u2", "p2", -1.0), ("u3", "p1", 1.0), ("u3", "p2", 1.0), ("u4", "p2", -1.0)]
    )
    got = rows_of(beliefs.user_to_product(start), "mp_bad", "mp_good", "mu_fraud")
    for edge in ("e0", "e2", "e3"):
        assert got[edge] == pytest.approx([0.45, 0.55, 1.0])
    assert got["e1"] == pytest.approx([0.55, 0.45, 1.0])
    assert got["e4"] == [1.0, 1.0, 1.0]  # a user seen once says nothing new


def test_messages_and_beliefs_add_up(crowd):
    vertices, start = crowd
    done = beliefs.run_lbp(start, 3)
    for r in done.where("not single_user and s <> 0").collect():
        assert r.mp_bad + r.mp_good == pytest.approx(1.0)
    nodes = beliefs.node_beliefs(vertices, done).collect()
    for n in nodes:
        pair = (n.p_fraud, n.p_honest) if n.type == "u" else (n.p_bad, n.p_good)
        other = (n.p_bad, n.p_good) if n.type == "u" else (n.p_fraud, n.p_honest)
        assert other == (None, None)
        assert pair == (None, None) if n.deg == 1 else sum(pair) == pytest.approx(1.0)


def test_heavy_vertices_give_the_same(crowd):
    _, start = crowd
    close(
        rows_of(beliefs.run_lbp(start, 3), *beliefs.MESSAGES),
        rows_of(beliefs.run_lbp(start, 3, group_limit=20), *beliefs.MESSAGES),
    )


def test_shortcut_for_single_endpoints_is_exact(crowd):
    _, start = crowd
    step = start
    for _ in range(3):
        step = beliefs.product_to_user(beliefs.user_to_product(step))
    close(rows_of(beliefs.run_lbp(start, 3), *beliefs.MESSAGES), rows_of(step, *beliefs.MESSAGES))


def test_biased_start_is_iterated_in_full(crowd):
    _, start = crowd
    biased = start.withColumns({"mp_bad": F.lit(0.7), "mp_good": F.lit(0.3)})
    step = biased
    for _ in range(2):
        step = beliefs.product_to_user(beliefs.user_to_product(step))
    close(rows_of(beliefs.run_lbp(biased, 2), *beliefs.MESSAGES), rows_of(step, *beliefs.MESSAGES))


def test_sampling_everything_changes_nothing(crowd):
    _, start = crowd
    sampled = beliefs.run_lbp(start, 2, sampling=beliefs.Sampling(max_deg=10, sample_size=10_000))
    close(rows_of(sampled, *beliefs.MESSAGES), rows_of(beliefs.run_lbp(start, 2), *beliefs.MESSAGES))


def test_sampling_repeats_and_survives_heavy_vertices(crowd):
    _, start = crowd
    sampling = beliefs.Sampling(max_deg=10, sample_size=5)
    once = rows_of(beliefs.run_lbp(start, 2, sampling=sampling), *beliefs.MESSAGES)
    close(once, rows_of(beliefs.run_lbp(start, 2, sampling=sampling, group_limit=20), *beliefs.MESSAGES))


def test_snapshots_resume_and_convergence(spark, crowd, folder):
    _, start = crowd
    path = folder + "/snapshots"
    beliefs.run_lbp(start, 2, snapshot_dir=path)
    assert last_iteration(spark, path) == 2
    resumed = beliefs.run_lbp(read_snapshot(spark, path, 2, start.schema), 9, start=3, snapshot_dir=path)
    close(rows_of(resumed, *beliefs.MESSAGES), rows_of(beliefs.run_lbp(start, 11), *beliefs.MESSAGES))
    report = reports.convergence(read_snapshots(spark, path)).orderBy("iteration").collect()
    assert [r.iteration for r in report] == list(range(1, 12))
    assert report[0].fraud_diff is None
    assert report[4].bad_diff == pytest.approx(report[3].bad - report[4].bad)


def test_zero_scores_keep_their_message_unless_magnitude_is_off(spark):
    _, start = belief_graph(spark, [("u1", "p1", 0.0), ("u1", "p2", 0.5), ("u2", "p1", 0.5)])
    assert rows_of(beliefs.user_to_product(start), "mp_bad", "mp_good")["e0"] == [1.0, 1.0]
    plain = rows_of(beliefs.user_to_product(start, sign_mag_effect=False), "mp_bad", "mp_good")["e0"]
    assert plain == pytest.approx([0.55, 0.45])
    assert tuple(beliefs.unscored_edges(start).first()) == (0, 1)


def test_repeat_reviews_raise_priors(spark):
    rows = [("u1", "p1", 0.5)] * 3 + [("u1", "p2", 0.5)] * 2 + [("u2", "p1", -0.5)]
    vertices, start = belief_graph(spark, rows)
    repeats = graph.repeat_reviews(start.withColumn("unix_review_time", F.lit(1)))
    assert {(r.src, r.dst, r["count"]) for r in repeats.collect()} == {("u1", "p1", 3), ("u1", "p2", 2)}
    v, e = beliefs.boost_priors(vertices, start, repeats)
    assert {r.id: r.prior_fraud for r in v.collect()} == {"u1": 12.0, "u2": 2.0, "p1": 2.0, "p2": 2.0}
    got = rows_of(e, *beliefs.PRIORS)
    assert got["e0"] == [6.0, 2.0, 6.0, 2.0] and got["e3"] == [4.0, 2.0, 4.0, 2.0] and got["e5"] == [2.0] * 4


def test_vertex_priors_reach_the_edges(spark):
    df = spark.createDataFrame([("e0", "u1", "p1", 0.5), ("e1", "u1", "p2", 0.5)], "edge_id string, src string, dst string, s double")
    vertices = graph.degrees(df).withColumn("prior_fraud", F.when(F.col("type") == "u", 3.0).otherwise(2.0))
    _, e = beliefs.init_beliefs(vertices, graph.with_endpoint_degrees(df, vertices))
    assert {tuple(r) for r in e.select("prior_fraud", "prior_bad").collect()} == {(3.0, 2.0)}


def marginals(edges, nodes):
    """Brute force over all states; edges are (user, product, s)."""
    weight = {n: [0.0, 0.0] for n in nodes}
    for states in itertools.product((0, 1), repeat=len(nodes)):
        at = dict(zip(nodes, states))
        total = 1.0
        for u, p, s in edges:
            total *= (POSITIVE if s > 0 else NEGATIVE)[at[u]][at[p]]
        for n in nodes:
            weight[n][at[n]] += total
    return {n: w[0] / sum(w) for n, w in weight.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_on_trees(spark, seed):
    pick = random.Random(seed)
    nodes, edges = ["u0"], []
    for i in range(1, 12):
        other = pick.choice(nodes)
        node = f"{'p' if other[0] == 'u' else 'u'}{i}"
        edges.append((other, node, pick.choice([-0.5, 0.5])) if other[0] == "u" else (node, other, pick.choice([-0.5, 0.5])))
        nodes.append(node)
    degree = {n: sum(n in e[:2] for e in edges) for n in nodes}
    inner = [n for n in nodes if degree[n] > 1]
    expected = marginals([e for e in edges if degree[e[0]] > 1 and degree[e[1]] > 1], inner)
    vertices, start = belief_graph(spark, edges)
    found = beliefs.node_beliefs(vertices, beliefs.run_lbp(start, 12)).collect()
    for n in found:
        if n.id in inner:
            assert (n.p_fraud if n.type == "u" else n.p_bad) == pytest.approx(expected[n.id], abs=1e-9)


def test_constants_and_maximum(spark):
    df = spark.createDataFrame([("a", 2), ("b", 4)], "id string, deg int")
    wide = beliefs.add_random_variable(df, "x", ["low", "high"], 0.25)
    assert wide.columns == ["id", "deg", "x=low", "x=high"] and wide.first()["x=low"] == 0.25
    assert [r.share for r in beliefs.max_normalise(df, [("deg", "share")]).orderBy("id").collect()] == [0.5, 1.0]
    zero = df.withColumn("deg", F.lit(0))
    assert beliefs.max_normalise(zero, [("deg", "share")]).first().share is None


def test_rows_without_a_heavy_flag_stay(spark):
    rows = spark.createDataFrame([("a", True, 1.0), ("a", True, 2.0), ("b", None, 4.0), ("c", False, 8.0)], "k string, heavy boolean, x double")
    summed = skew.add_group_sum(rows, "k", F.col("x"), "total", F.col("heavy"))
    assert sorted((r.k, r.total) for r in summed.collect()) == [("a", 3.0), ("a", 3.0), ("b", 4.0), ("c", 8.0)]


@pytest.mark.parametrize("options", [{}, {"group_limit": 20}, {"broadcast_ids": 0}, {"sampling": beliefs.Sampling(max_deg=10, sample_size=5, exact=True)}])
def test_active_set_is_exact_without_tolerance(crowd, options):
    _, start = crowd
    plain = {k: v for k, v in options.items() if k != "broadcast_ids"}
    settled, rounds = active.run_lbp_active(start, 4, **options)
    close(rows_of(settled, *beliefs.MESSAGES), rows_of(beliefs.run_lbp(start, 4, **plain), *beliefs.MESSAGES))
    assert settled.columns == start.columns and settled.count() == start.count()
    assert [(r.iteration, r.side) for r in rounds.orderBy("iteration", F.desc("side")).collect()] == [(i, s) for i in range(1, 5) for s in ("user", "product")]


def test_active_set_shrinks_and_ends(spark):
    pick = random.Random(4)
    # small trees of different depth, which settle one after another, and one ring
    edges = []
    for t in range(30):
        for k in range(1 + t // 5):
            edges += [(f"u{t}-{k}", f"p{t}-{k}", pick.choice([-0.5, 0.5])), (f"u{t}-{k}", f"p{t}-{k + 1}", pick.choice([-0.5, 0.5]))]
    edges += [(f"ur{k}", f"pr{(k + d) % 5}", 0.5 if k else -0.5) for k in range(5) for d in (0, 1)]
    _, start = belief_graph(spark, edges)
    settled, rounds = active.run_lbp_active(start, 12)
    close(rows_of(settled, *beliefs.MESSAGES), rows_of(beliefs.run_lbp(start, 12), *beliefs.MESSAGES))
    shuffled = [r.shuffled_edges for r in rounds.where("side = 'user'").orderBy("iteration").collect()]
    assert shuffled[0] > shuffled[2] > shuffled[4] and shuffled == sorted(shuffled, reverse=True)
    loose, fewer = active.run_lbp_active(start, 12, tolerance=1e-3)
    assert fewer.agg(F.sum("shuffled_edges")).first()[0] < rounds.agg(F.sum("shuffled_edges")).first()[0]
    assert fewer.agg(F.max("iteration")).first()[0] < 12  # nothing moves any more
    exact, near = rows_of(settled, "mp_bad"), rows_of(loose, "mp_bad")
    assert all(abs(near[k][0] - exact[k][0]) < 1e-2 for k in exact)


def test_active_set_without_edges(crowd):
    _, start = crowd
    settled, rounds = active.run_lbp_active(start.where("false"), 3)
    assert settled.isEmpty() and rounds.agg(F.sum("shuffled_edges")).first()[0] == 0
    untouched, none = active.run_lbp_active(start, 0)
    assert none.isEmpty()
    close(rows_of(untouched, *beliefs.MESSAGES), rows_of(start, *beliefs.MESSAGES))


def test_hot_vertices_hear_exactly_k(crowd):
    _, start = crowd
    sample = beliefs.Sampling(max_deg=10, sample_size=4, exact=True)
    marked = sample.prepare(start)
    for key, degree in (("src", "u_deg"), ("dst", "p_deg")):
        heard = marked.where(sample.keeps(degree)).groupBy(key, degree).count().collect()
        assert heard and all(r["count"] == (4 if r[degree] >= 10 else r[degree]) for r in heard)
        assert len(heard) == start.select(key).distinct().count()
    picked = sampling.bottom_k(start, "dst", 4).where("rank = 1").collect()
    first = {r.dst: min((hashlib.md5(x.edge_id.encode()).hexdigest()[:8], x.edge_id) for x in start.where(F.col("dst") == r.dst).collect())[1] for r in picked[:3]}
    assert {r.dst: r.edge_id for r in picked if r.dst in first} == first
    # groups are cut to k rows before they are shuffled
    plan = sampling.bottom_k(cut(start), "dst", 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    salted = beliefs.run_lbp(start, 2, sampling=sample, group_limit=20)
    close(rows_of(beliefs.run_lbp(start, 2, sampling=sample), *beliefs.MESSAGES), rows_of(salted, *beliefs.MESSAGES))
    with pytest.raises(ValueError, match="k must"):
        sampling.bottom_k(start, "dst", 0)


def test_belief_edges_carry_no_column_that_is_not_used(spark, monkeypatch):
    from plumbline.plans import catalog

    staged, stage = {}, catalog.stage

    def recorded(df, name, *rest):
        staged[name] = set(df.columns)
        return stage(df, name, *rest)

    monkeypatch.setattr(catalog, "stage", recorded)
    catalog._belief_graph(catalog._offers(spark, "/root/testdata/sf0.001"))
    assert staged["belief-edges"] == {"edge_id", "src", "dst", "s", "u_deg", "single_user", "p_deg", "single_product"}


def half_steps_of(monkeypatch, run):
    """The states that go into a sum over vertices while ``run`` works."""
    seen, plain = [], beliefs.add_group_sum

    def watched(rows, key, *rest):
        seen.append((key, rows))
        return plain(rows, key, *rest)

    monkeypatch.setattr(beliefs, "add_group_sum", watched)
    run()
    return seen


def test_a_neutral_start_needs_no_sum_over_users(crowd, monkeypatch):
    _, start = crowd
    assert [key for key, _ in half_steps_of(monkeypatch, lambda: beliefs.run_lbp(start, 2))] == ["dst", "src", "dst"]
    told = start.withColumns({"mu_fraud": F.lit(0.7), "mu_honest": F.lit(0.3)})
    assert [key for key, _ in half_steps_of(monkeypatch, lambda: beliefs.run_lbp(told, 2))][:2] == ["src", "dst"]


def test_a_message_that_is_replaced_is_not_shuffled(crowd, monkeypatch):
    _, start = crowd
    for key, rows in half_steps_of(monkeypatch, lambda: beliefs.run_lbp(start, 2)):
        single, sent = ("single_user", "_mp") if key == "src" else ("single_product", "_mu")
        sends = rows.where(~F.col(single) & (F.col("s") != 0))
        assert sends.count() and not sends.where(F.col(sent).isNotNull()).count()


def uniform_states(monkeypatch, start):
    return {c for _, rows in half_steps_of(monkeypatch, lambda: beliefs.run_lbp(start, 1)) for c in rows.columns}


def test_the_same_prior_everywhere_is_no_part_of_the_state(crowd, monkeypatch):
    _, start = crowd
    assert not {"prior_fraud", "prior_honest"} & uniform_states(monkeypatch, start)
    mixed = start.withColumn("prior_bad", F.when(F.col("dst") == "p0", 3.0).otherwise(2.0))
    assert "prior_bad" in uniform_states(monkeypatch, mixed)
    settled = beliefs.run_lbp(mixed, 2)
    assert settled.columns == start.columns
    step = mixed
    for _ in range(2):
        step = beliefs.product_to_user(beliefs.user_to_product(step))
    close(rows_of(settled, *beliefs.MESSAGES, *beliefs.PRIORS), rows_of(step, *beliefs.MESSAGES, *beliefs.PRIORS))


@pytest.fixture(scope="module")
def lonely(spark):
    """Mostly products with one review, some users with one as well, and a core of shared ones."""
    pick = random.Random(11)
    rows = [(f"u{pick.randrange(40)}", f"q{i}", pick.choice([-0.6, 0.0, 0.4])) for i in range(150)]
    rows += [(f"v{i}", pick.choice(["p0", "p1", f"r{i}"]), pick.choice([-0.6, 0.4])) for i in range(30)]
    rows += [(f"u{pick.randrange(40)}", f"p{pick.randrange(8)}", pick.choice([-0.6, 0.4])) for _ in range(60)]
    return belief_graph(spark, rows)


@pytest.mark.parametrize("options", [{}, {"group_limit": 5}])
def test_edges_of_once_seen_products_stay_in_place(lonely, folder, monkeypatch, options):
    _, start = lonely
    step = start
    for _ in range(2):
        step = beliefs.product_to_user(beliefs.user_to_product(step))
    done = {}
    seen = half_steps_of(monkeypatch, lambda: done.update(plain=beliefs.run_lbp(start, 2, **options)))
    close(rows_of(done["plain"], *beliefs.MESSAGES), rows_of(step, *beliefs.MESSAGES))
    assert not seen[-1][1].where("single_product").count() and seen[-1][0] == "dst"
    assert not seen[-2][1].where("single_user").count() and seen[-2][0] == "src"
    written = beliefs.run_lbp(start, 2, snapshot_dir=folder + "/rounds", **options)
    close(rows_of(written, *beliefs.MESSAGES), rows_of(step, *beliefs.MESSAGES))


def test_edges_staged_by_product_meet_their_messages_again(crowd, lonely):
    for _, start in (crowd, lonely):
        placed = stage(start, "placed", False, "dst")
        lean = beliefs.run_lbp(placed, 3, by_product=True)
        assert lean.columns == start.columns and dict(lean.dtypes) == dict(start.dtypes)
        close(rows_of(lean, *start.columns[5:]), rows_of(beliefs.run_lbp(start, 3), *start.columns[5:]), 1e-12)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_labels_need_one_shuffle_of_the_edges(spark, lonely):
    from plumbline.plans import catalog

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        folder = "/root/testdata/sf0.001"
        dense = exchanges(catalog._labelled(catalog._reviews(spark, folder, placed=True)))
        assert len(dense) == 2 and not any("(dst#" in line for line in dense)  # what users heard, and the edges
        vertices, start = lonely
        vertices, settled = stage(vertices, "vertices", False, "id"), beliefs.run_lbp(start, 2)
        sparse = exchanges(fusion.fuse_review_labels(beliefs.node_beliefs(vertices, settled), settled))
        assert len(sparse) == 2 and not any("(src#" in line for line in sparse)  # what products heard, and the edges
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_vertices_of_other_types_have_no_belief(spark, crowd):
    vertices, start = crowd
    extra = vertices.where("id = 'u0'").withColumn("type", F.lit("x"))
    nameless = vertices.where("id = 'u0'").withColumn("type", F.lit(None).cast("string"))
    found = beliefs.node_beliefs(vertices.unionByName(extra).unionByName(nameless), start).where("id = 'u0'").collect()
    assert {(r.type, r.p_fraud is None) for r in found} == {("u", False), ("x", True), (None, True)}
