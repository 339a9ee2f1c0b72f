import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline import Graph
from plumbline.operators import components, forests, graph, hits, merge, numbering
from plumbline.operators.numbering import number_rows
from plumbline.plans import skew
from plumbline.sources.snapshots import read_snapshots


def make(spark, ids, pairs):
    return Graph(
        spark.createDataFrame([(i,) for i in ids], "id string"),
        spark.createDataFrame(pairs, "src string, dst string"),
    )


HITS_EDGES = [tuple(e) for e in ("AB", "AC", "AD", "BA", "BD", "CE", "DB", "DC")]
DEMO = ("01234", [tuple(e) for e in ("01", "02", "03", "12", "34")])
SOCIAL = ("abcdefg", [tuple(e) for e in ("ab", "bc", "cb", "fc", "ef", "ed", "da", "ae")])


@pytest.mark.parametrize("limit", [1_000_000, 1])
def test_hits_worked_example(spark, limit):
    g = make(spark, "ABCDE", HITS_EDGES)
    hubs, authorities = hits.hits(g.vertices, g.edges, 1, group_limit=limit)
    assert {r.id: r.a_score for r in authorities.collect()} == pytest.approx(dict(A=0.5, B=1, C=1, D=1, E=0.5))
    assert {r.id: r.h_score for r in hubs.collect()} == pytest.approx(dict(A=1, B=0.5, C=1 / 6, D=2 / 3, E=0))


def test_hits_snapshots_start_values_and_parallel_edges(spark, folder):
    g = make(spark, "ABCDE", HITS_EDGES + [("A", "B")])
    hubs, authorities = hits.hits(g.vertices, g.edges, 2, snapshot_dir=folder + "/hits")
    kept = read_snapshots(spark, folder + "/hits/hubs").where("iteration = 2")
    assert {r.id: r.h_score for r in kept.collect()} == pytest.approx({r.id: r.h_score for r in hubs.collect()})
    first, _ = hits.hits(g.vertices, g.edges, 1)
    again, found = hits.hits(g.vertices, g.edges, 1, hubs=first)
    assert {r.id: r.h_score for r in again.collect()} == pytest.approx({r.id: r.h_score for r in hubs.collect()})
    assert {r.id: r.a_score for r in found.collect()} == pytest.approx({r.id: r.a_score for r in authorities.collect()})


def test_hits_without_edges(spark):
    g = make(spark, "AB", [])
    hubs, authorities = hits.hits(g.vertices, g.edges, 2)
    assert {r.h_score for r in hubs.collect()} == {0.0} and {r.a_score for r in authorities.collect()} == {0.0}


def labels(df):
    return {r.id: r.component for r in df.collect()}


def test_social_components(spark):
    g = make(spark, *SOCIAL)
    assert labels(components.connected_components(g.vertices, g.edges)) == {**dict.fromkeys("abcdef", "a"), "g": "g"}


@pytest.mark.parametrize("limit, one_task", [(1_000_000, components.ONE_TASK), (1_000_000, 0), (3, 0)])
def test_components_of_chains_and_stars(spark, limit, one_task):
    pick = random.Random(3)
    names = [f"{i:03d}" for i in range(150)]
    pick.shuffle(names)
    chain, star = names[:70], names[70:140]
    pairs = list(zip(chain, chain[1:])) + [(star[0], s) for s in star[1:]] + [(star[5], star[9]), (chain[3], chain[3])]
    g = make(spark, names, pairs)
    expected = {**dict.fromkeys(chain, min(chain)), **dict.fromkeys(star, min(star)), **{n: n for n in names[140:]}}
    assert labels(components.connected_components(g.vertices, g.edges, group_limit=limit, one_task=one_task)) == expected


def sparse_graph(n, pairs, seed):
    pick = random.Random(seed)
    links = [(pick.randrange(n), pick.randrange(n)) for _ in range(pairs)]
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return links, [find(x) for x in range(n)]


def test_forests_connect_the_same_ids():
    for seed in range(20):
        links, root = sparse_graph(300, 20 * seed, seed)
        found = forests.roots(np.array([(max(x), min(x)) for x in links], np.int64).reshape(-1, 2).T)
        assert dict(found.T.tolist()) == {i: r for i, r in enumerate(root) if i != r}


@pytest.mark.parametrize("one_task", [0, components.ONE_TASK])
def test_components_by_number_and_by_name(spark, monkeypatch, one_task):
    n = 2000
    links, root = sparse_graph(n, 1800, 5)
    edges = spark.createDataFrame(links + links[:50], "src int, dst int").repartition(7)
    found = components.connected_components(spark.range(n + 3).select(F.col("id").cast("int")), edges, one_task=one_task)
    assert found.schema["component"].dataType.simpleString() == "int"
    assert labels(found) == {**dict(enumerate(root)), **{n + k: n + k for k in range(3)}}

    name = lambda c: F.lpad(F.col(c).cast("string"), 5, "0")
    named = edges.select(name("src").alias("src"), name("dst").alias("dst"))
    # half of the ids are not listed, one is null
    listed = spark.range(0, n, 2).select(name("id").alias("id")).union(spark.createDataFrame([(None,)], "id string"))
    expected = {**{f"{i:05d}": f"{r:05d}" for i, r in enumerate(root) if i % 2 == 0}, None: None}
    assert labels(components.connected_components(listed, named, one_task=one_task)) == expected
    assert labels(components.connected_components(listed, named, group_limit=5, one_task=one_task)) == expected
    # hashes that collide
    monkeypatch.setattr(components, "_number", lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(c) % 500))
    assert labels(components.connected_components(listed, named, one_task=one_task)) == expected


def test_forests_save_rounds(spark, monkeypatch):
    pick = random.Random(8)
    names = list(range(4000))
    pick.shuffle(names)
    chain = spark.createDataFrame(list(zip(names, names[1:])), "src long, dst long").repartition(4)
    rounds = []
    small_star = components._small_star
    monkeypatch.setattr(components, "_small_star", lambda *x: rounds.append(1) or small_star(*x))

    def count(links):
        rounds.clear()
        assert components._star_rounds(links, 1_000_000).agg(F.max("parent")).first()[0] == 0
        return len(rounds)

    plain = components.undirected(chain)
    # a partition that holds a stretch of the chain gives one star
    stretches = chain.join(spark.createDataFrame(list(zip(names, range(4000))), "src long, at long"), "src").repartitionByRange(8, "at")
    assert 2 * count(forests.contract(components.undirected(stretches, distinct=False)).distinct()) <= count(plain)


def test_rounds_shrink_the_graph(spark, monkeypatch):
    """Every round leaves fewer links, so no round shuffles all of them again."""
    n = 6000
    links, root = sparse_graph(n, 7000, 11)
    edges = spark.createDataFrame(links, "src long, dst long").repartition(8)
    left = []
    shrunk = components._shrunk
    monkeypatch.setattr(components, "_shrunk", lambda *x: left.append(x[0].count()) or shrunk(*x))
    monkeypatch.setattr(components, "_star_rounds", lambda *x: pytest.fail("the rounds did not settle the graph"))
    for limit in (1_000_000, 3):
        left.clear()
        found = components.connected_components(spark.range(n), edges, group_limit=limit, one_task=50)
        assert labels(found) == dict(enumerate(root))
        assert left and all(4 * after <= 3 * before for before, after in zip(left, left[1:]))
        assert sum(left) <= 3 * left[0]


def test_many_forests_from_one_partition(spark, monkeypatch):
    links, root = sparse_graph(120, 700, 2)
    monkeypatch.setattr(forests, "TASK_LINKS", 100)
    batches = [pa.RecordBatch.from_pydict({"child": [max(a, b)], "parent": [min(a, b)]}) for a, b in links if a != b]
    made = {}

    class Links:
        def select(self, *names):
            return self

        def mapInArrow(self, f, schema):
            made["links"] = [x for out in f(iter(batches)) for x in zip(*out.to_pydict().values())]

    forests.contract(Links())
    assert len(made["links"]) < len(batches)
    found = forests.roots(np.array(made["links"]).T)
    assert dict(found.T.tolist()) == {i: r for i, r in enumerate(root) if i != r}


def test_pairs_with_unknown_ids_stay(spark):
    found = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "id string, component string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "?"), ("?", "?"), (None, "a")], "src string, dst string")
    same = {(r.src, r.dst): r.same_component for r in components.same_component(pairs, found).collect()}
    assert same == {("a", "b"): True, ("a", "c"): False, ("a", "?"): None, ("?", "?"): None, (None, "a"): None}


def test_scores_of_unlisted_ids_stay(spark):
    vertices = spark.createDataFrame([("a",)], "id string")
    edges = spark.createDataFrame([("a", "b"), ("z", "b")], "src string, dst string")
    hubs, authorities = hits.hits(vertices, edges, 1)
    assert {tuple(r) for r in hubs.collect()} == {("a", 1.0), ("z", 1.0)}
    assert {tuple(r) for r in authorities.collect()} == {("a", 0.0), ("b", 1.0)}


def test_long_chain_unravels_in_few_rounds(spark):
    n = 100_000
    chain = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    ring = spark.createDataFrame([(n, n + 1), (n + 1, n + 2), (n + 2, n)], "src long, dst long")
    edges = chain.union(ring)
    g = graph.Graph(spark.range(n + 3), edges)
    assert {r.id for r in components.cycle_core(g).collect()} == {n, n + 1, n + 2}


def test_cross_edges_and_pairs(spark):
    found = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "id string, component int")
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "b")], "src string, dst string")
    crossing = components.cross_component_edges(edges, found, group_limit=1)
    assert {tuple(r) for r in crossing.collect()} == {("a", "c", 1, 2), ("c", "b", 2, 1)}
    same = components.same_component(edges, found)
    assert {tuple(r) for r in same.collect()} == {("a", "b", True), ("a", "c", False), ("c", "b", False)}
    assert {tuple(r) for r in components.pairs_across_components(edges, found).collect()} == {("a", "c"), ("c", "b")}


@pytest.mark.parametrize(
    "ids, pairs, cyclic, core",
    [
        (*DEMO, True, {"0", "1", "2"}),
        ("abcd", [("a", "b"), ("b", "c"), ("c", "d")], False, set()),
        ("ab", [("a", "a"), ("a", "b")], True, {"a"}),
        ("ab", [("a", "b"), ("a", "b"), ("b", "a")], False, set()),
    ],
)
def test_cycles(spark, ids, pairs, cyclic, core):
    g = make(spark, ids, pairs)
    assert components.has_cycle(g) is cyclic
    assert components.cycle_report(g).first().has_cycle is cyclic
    assert {r.id for r in components.cycle_core(g, group_limit=1).collect()} == core


@pytest.mark.parametrize("limit", [1_000_000, 1])
def test_neighbours(spark, limit):
    g = make(spark, DEMO[0], DEMO[1] + [("4", "4")])
    wanted = spark.createDataFrame([("1",), ("4",)], "id string")
    got = sorted((r.id, r.neighbour) for r in graph.neighbours(g.edges, wanted, limit).collect())
    assert got == [("1", "0"), ("1", "2"), ("4", "3"), ("4", "4")]


def test_graph_checks(spark):
    g = make(spark, "aab", [("a", "b"), ("a", "z")])
    assert {tuple(r) for r in g.problems().collect()} == {("repeated id", "a"), ("unknown endpoint", "z")}
    with pytest.raises(ValueError):
        Graph(g.vertices, g.vertices)


def test_numbers_are_gapless_and_ordered(spark):
    rows = [(i % 7, f"r{i}") for i in range(1000)]
    df = spark.createDataFrame(rows, "t int, name string").repartition(6)
    got = number_rows(df, ["t", "name"], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 1001))
    assert [(r.t, r.name) for r in got] == sorted(rows)


def test_equal_rows_are_numbered_once_with_one_shuffle(spark, monkeypatch):
    rows = [(i % 40, None if i % 7 == 0 else f"{i % 5}") for i in range(400)]
    df = spark.createDataFrame(rows, "a int, b string")
    plans = []
    stage = numbering.stage
    monkeypatch.setattr(numbering, "stage", lambda d, name: plans.append(d._jdf.queryExecution().executedPlan().toString()) or stage(d, name))
    found = [(r.n, r.a, r.b) for r in number_rows(df, ["a", "b"], "n", distinct=True).orderBy("n").collect()]
    distinct = sorted(set(rows), key=lambda r: (r[0], r[1] is not None, r[1] or ""))
    assert found == [(i, *r) for i, r in enumerate(distinct, 1)]
    assert [p.count("Exchange ") for p in plans] == [1]


def test_build_graph(spark):
    row = "src string, dst string, overall double, reviewer_name string, unix_review_time long"
    reviews = spark.createDataFrame(
        [("u1", "p1", 5.0, "Ann", 20), ("u1", "p1", 5.0, "Ann", 20), ("u1", "p2", 1.0, "Anna", 10), ("u2", "p1", 4.0, "Bo", 10)], row
    )
    titles = spark.createDataFrame([("p1", "kite"), ("p1", "kite"), ("p1", "Kite"), ("p9", "x")], "asin string, title string")
    g = graph.build_graph(reviews, titles, "x")
    got = {r.id: (r.deg, r.type, r.name, r.several_name, r.n_distinct_names) for r in g.vertices.collect()}
    assert got == {
        "u1": (2, "u", "Anna", True, 2), "u2": (1, "u", "Bo", False, 1),
        "p1": (2, "p", "Kite", True, 2), "p2": (1, "p", "", False, 0),
    }
    assert {(r.edge_id, r.src, r.dst) for r in g.edges.collect()} == {("x1", "u1", "p2"), ("x2", "u2", "p1"), ("x3", "u1", "p1")}


def test_keys_are_only_counted_where_one_may_be_heavy(spark, monkeypatch):
    rows = spark.createDataFrame([(None,), ("a",)] + [("b",)] * 9 + [(f"c{i}",) for i in range(40)], "k string")
    assert [r[skew.HEAVY_KEY] for r in skew.heavy_if_any(rows, "k", 8).collect()] == ["b"]
    assert skew.heavy_if_any(rows, "k", 8, buckets=1).count() == 1
    assert skew.heavy_if_any(rows, "k", 9, buckets=1) is None
    monkeypatch.setattr(skew, "heavy_keys", lambda *x: pytest.fail("keys were shuffled"))
    assert skew.heavy_if_any(rows, "k", 20) is None
    assert skew.heavy_if_any(rows.limit(0), "k", 20) is None


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join(spark, how):
    rows = spark.createDataFrame([(f"k{0 if i % 3 else i % 20}", i) for i in range(300)], "k string, i int")
    table = spark.createDataFrame([(f"k{j}", j * 10) for j in range(0, 20, 2)], "id string, v int")
    plain = rows.join(table, rows.k == table.id, how).drop("id")
    salted = skew.lookup_join(rows, table, "k", "id", how, limit=10)
    assert sorted(map(tuple, salted.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


@pytest.mark.parametrize("limit", [10, 1000])
def test_rows_without_a_key_are_kept_and_spread(spark, limit):
    rows = spark.createDataFrame([(None if i % 2 else "k", i) for i in range(200)], "k string, i int")
    table = spark.createDataFrame([("k", 1)], "id string, v int")
    joined = skew.lookup_join(rows, table, "k", "id", "left", limit=limit)
    assert {(r.i, r.v) for r in joined.collect()} == {(i, None if i % 2 else 1) for i in range(200)}
    if limit == 1000:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        try:
            plan = skew.lookup_join(rows, table, "k", "id", "left", heavy=None)._jdf.queryExecution().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert "hashpartitioning(k" in plan and "_salt" in plan.split("hashpartitioning(k", 1)[1][:40]


def test_endpoint_degrees_with_heavy_ids(spark):
    pairs = [("u0", f"p{i}") for i in range(30)] + [(f"u{i}", "p0") for i in range(1, 30)]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    vertices = graph.degrees(edges)
    few, many = (sorted(map(tuple, graph.with_endpoint_degrees(edges, vertices, n).collect())) for n in (5, 1000))
    assert few == many and len(few) == len(pairs)
    got = {(r.src, r.dst): (r.u_deg, r.single_user, r.p_deg, r.single_product) for r in graph.with_endpoint_degrees(edges, vertices).collect()}
    assert got["u0", "p0"] == (30, False, 30, False) and got["u5", "p0"] == (1, True, 30, False)


PRIOR = "prior_fraud double, prior_honest double, prior_bad double, prior_good double"


def part(spark, rows, prior):
    return spark.createDataFrame([(*r, *[prior] * 4) for r in rows], f"id string, type string, deg long, {PRIOR}")


def test_merging_categories(spark):
    a = part(spark, [("x", "u", 2), ("p", "p", 2)], 2.0)
    b = part(spark, [("x", "u", 3), ("y", "u", 1), ("x", "p", 4)], 5.0)
    got = {(r.id, r.type): (r.deg, r.prior_bad, r.category) for r in merge.merge_vertices([(b, "B"), (a, "A")]).collect()}
    assert got == {
        ("x", "u"): (5, 5.0, ["A", "B"]), ("p", "p"): (2, 2.0, ["A"]),
        ("y", "u"): (1, 5.0, ["B"]), ("x", "p"): (4, 5.0, ["B"]),
    }
    with pytest.raises(ValueError):
        merge.merge_vertices([(a, "A"), (b, "A")])

    edge = "src string, dst string, u_deg long, single_user boolean, p_deg long, single_product boolean"
    ea = spark.createDataFrame([("x", "p", 2, False, 2, False), ("x", "p", 2, False, 2, False)], edge)
    eb = spark.createDataFrame([("x", "x", 1, True, 1, True)], edge)
    v, e = merge.merge_categories([(a, "A"), (b, "B")], [ea, eb])
    assert {(r.id, r.type): (r.deg, r.A, r.B) for r in v.collect()} == {("x", "u"): (3, 1, 1), ("p", "p"): (2, 1, 0), ("x", "p"): (1, 0, 1)}
    assert {(r.dst, r.u_deg, r.single_user, r.p_deg, r.single_product) for r in e.collect()} == {("p", 3, False, 2, False), ("x", 3, False, 1, True)}


def test_rows_ranked_in_place_get_the_same_numbers(spark):
    pick = random.Random(3)
    rows = [
        (pick.randrange(4), f"u{pick.randrange(5)}", (p := pick.randrange(4)), f"p{p}", pick.choice([None, "a", "b"]), pick.choice([None, 0.5, 1.5]))
        for _ in range(600)
    ]
    df = spark.createDataFrame(rows + rows[:50], "time int, src string, part int, dst string, vote string, x double")
    order = ["time", "src", "dst", "vote", "x"]
    plain = number_rows(df.drop("part"), order, "n", distinct=True)
    near = number_rows(df, order, "n", distinct=True, keep=["src", "dst", "x"], place="part", lead=3)
    assert near.columns == ["src", "dst", "x", "n"]
    assert sorted(map(tuple, near.collect()), key=lambda r: r[3]) == sorted(map(tuple, plain.select("src", "dst", "x", "n").collect()), key=lambda r: r[3])
    assert plain.count() == len(set(r[:2] + r[3:] for r in rows))


def test_ranking_in_place_sends_only_leading_columns_to_the_ranges(spark, monkeypatch):
    from plumbline.operators import numbering

    seen, stage_ = [], numbering.stage
    monkeypatch.setattr(numbering, "stage", lambda df, name: seen.append(df) or stage_(df, name))
    df = spark.range(50).selectExpr("id % 7 as a", "id % 3 as b", "cast(id as string) as wide", "id % 7 as place")
    number_rows(df, ["a", "b", "wide"], "n", keep=["a"], place="place", lead=2)
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("RepartitionByExpression")]
    assert "wide" not in above and seen[0].columns == ["a", "_slot"]


@pytest.mark.parametrize("limit", [1_000_000, 6])
def test_degrees_counted_in_place(spark, limit):
    pick = random.Random(5)
    rows = [(i, pick.choice(["u0", f"u{pick.randrange(30)}", None]), pick.choice(["p0", f"p{pick.randrange(40)}"])) for i in range(300)]
    edges = spark.createDataFrame(rows, "n int, src string, dst string").where("src is not null")
    known = graph.with_endpoint_degrees(edges, graph.degrees(edges), limit)
    counted = graph.with_endpoint_degrees(edges, limit=limit)
    assert sorted(map(tuple, counted.select(known.columns).collect())) == sorted(map(tuple, known.collect()))


@pytest.mark.parametrize("twice", [False, True])
def test_reviews_need_names_only_if_keys_do_not_tell_customers_apart(spark, folder, twice):
    import os

    from plumbline.plans import catalog
    from plumbline.sources import commerce

    given = "/root/testdata/sf0.001"
    for name in ("lineitem", "orders", "part", "documents"):
        os.symlink(f"{given}/{name}.parquet", f"{folder}/{name}.parquet")
    customer = spark.read.parquet(f"{given}/customer.parquet")
    customer = customer.withColumn("c_name", F.when(F.col("c_custkey") % 5 > 0, F.col("c_name")))
    if twice:
        customer = customer.unionByName(customer.where("c_custkey % 3 = 0").withColumn("c_name", F.lit("Other")))
    customer.write.parquet(f"{folder}/customer.parquet")
    plain, placed = commerce.reviews(spark, folder), commerce.reviews(spark, folder, placed=True)
    assert placed.drop(commerce.PLACE).columns == plain.columns
    names = placed.select("reviewer_name").distinct().collect()
    assert (len(names) > 3) == twice
    found = [catalog._numbered(df.unionByName(df.where("verified"))).select("_rank", "src", "dst", "s") for df in (plain, placed)]
    first, second = (sorted(map(tuple, df.collect())) for df in found)
    assert first == second and len(first) == plain.distinct().count()
