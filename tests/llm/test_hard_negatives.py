import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import hard_negatives as hn


def brute(rows):
    """Over (id, label, whole-number vector) rows."""
    rows = sorted({(i, x, tuple(v)) for i, x, v in rows if None not in (i, x, v) and None not in v})
    out = []
    for i, label, v in rows:
        if i % 50:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), k, x) for k, x, w in rows if k != i and len(w) == len(v)]
        for p, positive, _ in sorted(s for s in scored if s[2] == label)[:5]:
            fits = sorted(s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p)
            out += [(i, positive, rank, k, -p, -s) for rank, (s, k, _) in enumerate(fits[:3], 1)]
    return sorted(out)


def cloud(n, dim, labels, seed, spread=0.25):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dim))
    labels_of = rng.integers(0, labels, n)
    scale = rng.lognormal(0, 0.4, (n, 1))  # lengths that differ
    return [(i * 5, int(x), (40 * v).astype(int).tolist()) for i, (x, v) in enumerate(zip(labels_of, scale * (centres[labels_of] * spread + rng.normal(size=(n, dim)))))]


def mined(spark, rows, **options):
    made = spark.createDataFrame(rows, "id long, label int, vector array<long>")
    return sorted(map(tuple, hn.mine(made.repartition(5), F.col("id") % 50 == 0, **options).collect()))


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_as_by_all_pairs(spark, monkeypatch, spread):
    rows = cloud(400, 8, 4, 5, spread)
    want = brute(rows)
    assert want and mined(spark, rows) == want
    assert mined(spark, rows, limit=100) == want  # many blocks of anchors


def test_candidates_hold_all_that_reach_the_cosine():
    rng = np.random.default_rng(1)
    for trial in range(40):
        vectors = rng.normal(size=(200, 6)) * rng.lognormal(0, 1, (200, 1))
        for group in hn._buckets(np.arange(200), np.zeros(200, int), vectors).values():
            for bucket in group:
                q = rng.normal(size=6) * (rng.random(6) < 0.7) + [0, 0, 0, 0, 0, 1e-3]
                q /= np.linalg.norm(q)
                cosine = rng.uniform(-0.2, 1)
                rows = bucket.candidates(q, np.argsort(-np.abs(q))[: hn.FOCUS], cosine)
                kept = set(np.arange(len(bucket.ids))[rows].tolist())
                assert set(np.flatnonzero(bucket.directions @ q >= cosine).tolist()) <= kept


def test_lists_prune():
    rows = cloud(3000, 8, 1, 3, 3.0)
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[2] for r in rows], float)
    (group,) = hn._buckets(ids, np.zeros(len(ids), int), vectors).values()
    assert len(group) > 3 and all(b.longest >= s.longest for b, s in zip(group, group[1:]))
    q = -group[0].directions[0]  # the far side of the cloud
    assert sum(len(b.ids[b.candidates(q, np.argsort(-np.abs(q))[: hn.FOCUS], 0.9)]) for b in group) < len(ids) / 4


def test_odd_rows(spark):
    rng = random.Random(2)
    vector = lambda: [rng.randrange(-9, 10) for _ in range(3)]
    rows = [(i, i % 3, vector()) for i in range(0, 200)]
    rows += [(None, 1, [1, 2, 3]), (50, None, [1, 2, 3]), (51, 1, None), (52, 1, [1, None, 3])]
    rows += [(300, 1, []), (301, 1, []), (302, 2, []), (303, 1, [5, 5]), (350, 1, [0, 0, 0]), (351, 2, [0, 0, 0])]
    rows += [rows[0], rows[0], rows[7], (100, 2, [3, 3, 3]), (7, 0, rows[7][2])]  # repeats, and ids shared by different rows
    rows += [(400 + i, i % 2, [2, 2, 2]) for i in range(30)]  # ties
    rows += [(500, 0, [2**20, 2**21, -(2**20)]), (501, 0, [2**29, 5, 3]), (502, 1, [2**28, 1, 1])]  # beyond exact doubles
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1, 2])]) == []  # no anchor


def test_scores_beyond_a_long_are_an_error():
    with pytest.raises(ValueError, match="long"):
        hn._checked(np.array([[2**40, 1]]), np.array([[2**40, 1]]))


def test_embeddings_are_quantised_and_relabelled(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=4)], i % 10, "mine") for i in range(260)]
    rows += [(50, None, 3, "mine"), (56, [1.0, math.nan, 0.0, 0.0], 3, "mine"), (57, [math.inf, 0.0, 0.0, 0.0], 3, "mine"), (58, [None, 0.0, 0.0, 0.0], 3, "mine")]
    made = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id string")
    whole = [(i, (x + 1) % 10 if i % 7 == 0 else x, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v, x, _ in rows[:260]]
    assert sorted(map(tuple, hn.of_embeddings(made).collect())) == brute(whole)
