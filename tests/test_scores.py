import pytest
from pyspark.sql import functions as F

from plumbline.functions import buckets, masses
from plumbline.functions.scoring import signed_score
from plumbline.operators import beliefs, fusion, graph, scoring, sentiment
from plumbline.operators.sentiment import lexicon_sentiment

REVIEW = "overall double, vote string, compound double"


def scores(spark, rows, **options):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {REVIEW}")
    return [(r.vote, r.s) for r in scoring.review_score(df, **options).orderBy("i").collect()]


def test_score_contract(spark):
    rows = [
        (1.0, None, 1.0),  # exact zero: the rating decides
        (5.0, "1,234", 1.0),  # votes push to the upper bound
        (1.0, "1,234", -0.5),  # and to the lower one
        (3.0, "", 0.1),
        (4.9, "10", 0.0),  # stars are cut to 4
        (2.0, "abc", -0.2),
        (6.0, "1", 0.5),  # no such rating
    ]
    got = scores(spark, rows)
    assert [v for v, _ in got] == [0, 1234, 1234, 0, 10, 0, 1]
    assert [s for _, s in got[:6]] == pytest.approx([-0.5, 1.0, -1.0, 0.2, 0.5, -0.5])
    assert got[6][1] is None


def test_score_tie_on_text(spark):
    assert scores(spark, [(1.0, None, 1.0)], tie="text")[0][1] == pytest.approx(0.5)
    with pytest.raises(ValueError):
        signed_score(F.lit(1.0), F.lit(1.0), F.lit(0), tie="coin")


def test_votes_break_a_zero_mean(spark):
    assert scores(spark, [(1.0, "3", 1.0)])[0][1] == pytest.approx(0.03)


def test_rejected_rows(spark):
    df = spark.createDataFrame([(1.0, "x"), (0.0, "1"), (5.0, ""), (None, None)], "overall double, vote string")
    assert tuple(scoring.rejected_rows(df).first()) == (4, 2, 1)


def test_zero_compound_repair(spark):
    rows = [(0, 5.0, 0.0, 1.0, 0.0, 0.0), (1, 2.0, 0.0, 0.0, 0.0, 0.0), (2, 5.0, 0.3, 0.5, 0.2, 0.0), (3, 5.0, 0.1, 0.5, 0.4, 0.6)]
    df = spark.createDataFrame(rows, "i int, overall double, neg double, neu double, pos double, compound double")
    got = [tuple(r)[2:] for r in scoring.repair_zero_compound(df).orderBy("i").collect()]
    assert got[0] == pytest.approx((0.0, 0.0, 0.1, 0.1, 0.1))
    assert got[1] == pytest.approx((0.06, 0.0, 0.0, -0.06, -0.06))
    assert got[2] == pytest.approx((0.3, 0.5, 0.2, -0.3, -0.3))
    assert got[3] == pytest.approx((0.1, 0.5, 0.4, 0.6, 0.4))


LEXICON = {
    "smart": 1.7, "handsome": 2.2, "funny": 1.9, "good": 1.9, "great": 3.1, "horrible": -2.5,
    "bad": -2.5, "sux": -1.5, "uncompelling": -0.9,
}

# compounds published with the model
PUBLISHED = {
    "VADER is smart, handsome, and funny.": 0.8316,
    "VADER is smart, handsome, and funny!": 0.8439,
    "VADER is very smart, handsome, and funny.": 0.8545,
    "VADER is VERY SMART, handsome, and FUNNY.": 0.9227,
    "VADER is VERY SMART, handsome, and FUNNY!!!": 0.9342,
    "VADER is VERY SMART, uber handsome, and FRIGGIN FUNNY!!!": 0.9469,
    "VADER is not smart, handsome, nor funny.": -0.7424,
    "The book was good.": 0.4404,
    "At least it isn't a horrible book.": 0.431,
    "The book was only kind of good.": 0.3832,
    "The plot was good, but the characters are uncompelling and the dialog is not great.": -0.7042,
    "Today SUX!": -0.5461,
    "Not bad at all": 0.431,
    "nothing here": 0.0,
    "": 0.0,
}


@pytest.mark.parametrize("broadcast", [1000, 0])
def test_published_sentiments(spark, broadcast):
    texts = spark.createDataFrame(list(enumerate(PUBLISHED)), "i int, text string")
    words = spark.createDataFrame(list(LEXICON.items()), "token string, valence double")
    moods = lexicon_sentiment(texts, "i", "text", words, max_broadcast=broadcast, group_limit=5).orderBy("i").collect()
    assert [m.compound for m in moods] == pytest.approx(list(PUBLISHED.values()), abs=1e-4)
    first = moods[0]
    assert (first.neg, first.neu, first.pos) == (0.0, 0.254, 0.746)
    assert all(abs(m.neg + m.neu + m.pos - 1) < 0.002 for m in moods[:-1])


def test_only_rare_words_of_a_large_lexicon_are_shuffled(spark, monkeypatch):
    texts = spark.createDataFrame([(i, f"{t} good bad") for i, t in enumerate([*PUBLISHED, *["good not bad"] * 40])], "i int, text string")
    words = spark.createDataFrame(list(LEXICON.items()), "token string, valence double")
    expected = sorted(map(tuple, lexicon_sentiment(texts, "i", "text", words).collect()))
    met = []
    join = sentiment.lookup_join
    monkeypatch.setattr(sentiment, "lookup_join", lambda rows, *x, **y: met.append(rows.select(x[1]).collect()) or join(rows, *x, **y))
    found = lexicon_sentiment(texts, "i", "text", words, max_broadcast=4, group_limit=5)
    assert sorted(map(tuple, found.collect())) == expected
    assert met and not {w for rows in met for (w,) in rows} & {"good", "bad", "not"}


def test_null_text_is_empty(spark):
    texts = spark.createDataFrame([(1, None)], "i int, text string")
    words = spark.createDataFrame([("good", 1.9)], "token string, valence double")
    assert tuple(lexicon_sentiment(texts, "i", "text", words).first()) == (1, 0.0, 0.0, 0.0, 0.0, 0.0)


def fused_by_hand(u_deg, p_deg, fraud, honest, bad, good, s):
    m1 = {"f": fraud, "g": honest, "?": 0.0}
    m2 = {"f": bad, "g": good} if s > 0 else {"f": good, "g": bad}
    if u_deg <= 5:
        m1 = {"f": fraud * u_deg / 5, "g": honest * u_deg / 5, "?": (fraud + honest) * (1 - u_deg / 5)}
    m2 = {"f": m2["f"] * 0.7, "g": m2["g"] * 0.7, "?": 0.3}
    if p_deg <= 30:
        lost = (m2["f"] + m2["g"]) * (1 - p_deg / 30)
        m2 = {"f": m2["f"] * p_deg / 30, "g": m2["g"] * p_deg / 30, "?": 0.3 + lost}
    conflict = m1["f"] * m2["g"] + m1["g"] * m2["f"]
    pair = {k: m1[k] * m2[k] + m1[k] * m2["?"] + m1["?"] * m2[k] for k in "fg"}
    return [x / (1 - conflict) for x in (pair["f"], pair["g"], m1["?"] * m2["?"])]


def test_fusion_grid(spark):
    rows = [
        (u, p, 0.8, 0.2, 0.3, 0.7, s) for u in (1, 5, 6) for p in (1, 30, 31) for s in (0.5, -0.5)
    ]
    names = ["u_deg", "p_deg", "fraud", "honest", "bad", "good", "score"]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["i", *names])
    found = df.withColumns(masses.fuse(*[F.col(n) for n in names])).orderBy("i").collect()
    for row, got in zip(rows, found):
        values = [got.fake, got.genuine, got.uncertainty]
        assert values == pytest.approx(fused_by_hand(*row))
        assert sum(values) == pytest.approx(1.0)


def test_fusion_without_answer_is_null(spark):
    df = spark.createDataFrame(
        [(9, 99, 0.8, 0.2, 0.3, 0.7, None)], "u int, p int, f double, h double, b double, g double, s double"
    )
    found = df.select(*[m.alias(n) for n, m in masses.fuse(*[F.col(c) for c in df.columns]).items()])
    label = found.withColumn("label", masses.decide(*[F.col(c) for c in ("fake", "genuine", "uncertainty")])).first()
    assert tuple(label) == (None, None, None, None)


def test_label_ties(spark):
    df = spark.createDataFrame([(0.5, 0.5, 0.0), (0.3, 0.2, 0.6), (0.4, 0.3, 0.3)], "fake double, genuine double, uncertainty double")
    labels = df.select(masses.decide(F.col("fake"), F.col("genuine"), F.col("uncertainty")).alias("l")).collect()
    assert [r.l for r in labels] == ["genuine", "uncertain", "fake"]


def test_half_hundredths_do_not_follow_float_noise(spark):
    # sums that are half a hundredth in exact arithmetic, a bit above or below as floats
    halves = [0.125, 0.1 + 0.025, 0.3 - 0.175, 0.7 * 0.25 - 0.05, 0.325 - 0.2, 0.125 - 1e-16, 0.125 + 2e-16, 0.1249995001, 0.1249994]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(halves)], "i int, m double").orderBy("i")
    assert [r.m for r in df.select("i", masses.in_units(F.col("m")).alias("m")).collect()] == [13] * 8 + [12]
    assert [r.m for r in df.select("i", masses.in_units(F.col("m"), 4).alias("m")).collect()] == [1250] * 9
    with pytest.raises(ValueError, match="digits"):
        masses.in_units(F.col("m"), 7)
    tied = spark.createDataFrame([(0.505, 0.495, 0.0), (0.495, 0.505, 0.0), (0.3, 0.2, 0.5), (0.1 + 0.205, 0.2, 0.5051)], "fake double, genuine double, uncertainty double")
    units = [masses.in_units(F.col(c)) for c in tied.columns]
    assert [r.l for r in tied.select(masses.decide(*units).alias("l")).collect()] == ["fake", "genuine", "fake", "fake"]
    rounded = tied.select(*fusion.rounded_masses()).first()
    assert tuple(rounded) == (0.51, 0.5, 0.0)


def test_every_value_has_one_bucket(spark):
    values = [0.0, 0.1, 0.2, 0.3, 0.7, 0.9, 1.0, 0.29999, 0.3 - 1e-9]
    df = spark.createDataFrame([(v,) for v in values], "p double")
    assert [r.b for r in df.select(buckets.tenth(F.col("p")).alias("b")).collect()] == [0, 1, 2, 3, 7, 9, 9, 3, 3]


def test_whole_percent_halves_go_to_even(spark):
    df = spark.createDataFrame([(1, 8), (3, 8), (1, 3), (1, 1), (0, 7)], "n int, total int")
    got = [r.p for r in df.select(buckets.whole_percent(F.col("n"), F.col("total")).alias("p")).collect()]
    assert got == [12.0, 38.0, 33.0, 100.0, 0.0]


def test_labels_with_heavy_vertices(spark):
    rows = [(f"e{i}", "u0" if i < 30 else f"u{i % 7}", f"p{i % 3}", 0.5 if i % 2 else -0.5) for i in range(60)]
    edges = spark.createDataFrame(rows, "edge_id string, src string, dst string, s double")
    vertices = graph.degrees(edges)
    v, e = beliefs.init_beliefs(vertices, graph.with_endpoint_degrees(edges, vertices))
    settled = beliefs.run_lbp(e, 2)
    nodes = beliefs.node_beliefs(v, settled)
    few, many = (sorted(map(str, fusion.fuse_review_labels(nodes, settled, limit=n).collect())) for n in (5, 1000))
    assert few == many and len(few) == 60


def test_a_token_listed_twice_counts_once(spark):
    texts = spark.createDataFrame([(1, "a good day")], "id int, body string")
    once = spark.createDataFrame([("good", 1.9)], "token string, valence double")
    twice = once.union(once).union(spark.createDataFrame([("good", 2.5)], once.schema))
    found = [lexicon_sentiment(texts, "id", "body", lexicon).first() for lexicon in (once, twice)]
    assert found[0] == found[1] and found[0].compound == 0.4404


def test_unanswered_messages_say_nothing_for_either_side(spark):
    vertices = spark.createDataFrame(
        [("u", "u", None, None, None, None), ("p", "p", None, None, 0.3, 0.7)],
        "id string, type string, p_fraud double, p_honest double, p_bad double, p_good double",
    ).withColumn("deg", F.lit(1).cast("bigint"))
    edges = spark.createDataFrame(
        [("e", "u", "p", 1, 9, 0.0, 1.0, 1.0, 0.4, 0.6)],
        "edge_id string, src string, dst string, u_deg long, p_deg long, s double, mu_fraud double, mu_honest double, mp_bad double, mp_good double",
    )
    row = fusion.fuse_review_labels(vertices, edges).first()
    assert (row.fraudster, row.honest) == (0.5, 0.5)
    assert row.fake + row.genuine + row.uncertainty == pytest.approx(1.0)


def test_evidence_is_exact_however_it_is_packed(spark):
    schema = "edge_id string, src string, dst string, u_deg long, p_deg long, s double, mu_fraud double, mu_honest double, mp_bad double, mp_good double"
    pairs = [(0.45, 0.55), (1.0, 1.0), (0.33333, 0.66667), (0.0, 1.0), (7.25, 3.0), (0.1, 0.2), (0.0, 0.0), (-1.0, 2.0), (None, 1.0), (1e30, 1.0)]
    rows = [(f"e{i}{j}", f"u{j % 3}", f"p{i % 3}", 1, 1, -0.12346, *mu, *mp) for i, mu in enumerate(pairs) for j, mp in enumerate(pairs)]
    edges = spark.createDataFrame(rows, schema)
    nodes = [("u0", "u", 0.123449, 0.876551, None, None), ("p0", "p", None, None, 0.99996, 0.00004)]
    nodes += [(f"{k}{i}", k, None, None, None, None) for k in "up" for i in (1, 2)]
    for deg in (1, 9):  # either end may be joined first
        known = spark.createDataFrame([(*n[:2], deg, *n[2:]) for n in nodes], "id string, type string, deg long, p_fraud double, p_honest double, p_bad double, p_good double")
        found = {r.edge_id: r for r in fusion.endpoint_evidence(known, edges).collect()}
        assert len(found) == len(rows)
        for row in rows:
            got = found[row[0]]
            own = {"u": (0.1234, 0.8766) if row[1] == "u0" else None, "p": (1.0, 0.0) if row[2] == "p0" else None}
            for kind, pair, belief in (("u", row[6:8], (got.fraudster, got.honest)), ("p", row[8:10], (got.bad, got.good))):
                near = [None if x is None else round(x, 4) for x in pair]
                lent = (None, None) if None in near or sum(near) == 0 else tuple(x / sum(near) for x in near)
                assert belief == (own[kind] or lent), row
            assert (got.s, got.mu_fraud, got.mp_good) == (-0.1235, *(None if x is None else round(x, 4) for x in (row[6], row[9])))


def test_edges_are_shuffled_with_their_evidence_in_one_word(spark):
    columns = ["fraudster", "honest", "mp_bad", "mp_good"]
    df = spark.createDataFrame([(0.1234, 0.8766, 0.0, 1.0), (0.5, 0.5, 3.2767, 0.0001), (0.5, 0.5, 3.2768, 0.0)], ", ".join(f"{c} double" for c in columns))
    packed = fusion._packed(df, columns)
    assert packed.columns == ["_beside", "_word"] and [r._beside is None for r in packed.collect()] == [True, True, False]
    assert fusion._unpacked(packed, columns).collect() == df.collect()
