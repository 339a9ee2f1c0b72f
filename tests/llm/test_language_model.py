import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import language_model as lm
from plumbline.plans.cutting import staging


def tokens_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\\x20\\x09-\\x0D]+", low) + [None]


def discounts(counts):
    n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0
    found = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0 for k in (1, 2, 3)]
    return [d if 0 < d <= k else k / 2 for k, d in enumerate(found, 1)]


class Plain:
    """The same model by dictionaries."""

    def __init__(self, texts):
        lists = [tokens_of(t) for t in texts]
        self.words = Counter(w for x in lists for w in x)
        self.pairs = Counter(p for x in lists for p in zip(["<s>", *x], x))
        self.followers = defaultdict(list)
        for (v, _), c in self.pairs.items():
            self.followers[v].append(c)
        self.heads = Counter(w for _, w in self.pairs)
        self.dp, self.dh = discounts(self.pairs.values()), discounts(self.heads.values())

    @staticmethod
    def less(c, d):
        return c - d[min(c, 3) - 1] if c else 0.0

    def alone(self, w):
        pairs, size = len(self.pairs), len(self.words)
        unseen = sum(self.dh[min(c, 3) - 1] for c in self.heads.values()) / pairs if pairs else 1.0
        return self.less(self.heads[w], self.dh) / max(pairs, 1) + unseen / (size + 1)

    def chance(self, v, w):
        total = sum(self.followers.get(v, ()))
        if not total:
            return self.alone(w)
        rest = sum(self.dp[min(c, 3) - 1] for c in self.followers[v]) / total
        return self.less(self.pairs[v, w], self.dp) / total + rest * self.alone(w)

    def row(self, text):
        x = tokens_of(text)
        n, size = sum(self.words.values()), len(self.words)
        base = sum(math.log10((self.words[w] + 1) / (n + size + 1)) for w in x)
        full = sum(math.log10(self.chance(v, w)) for v, w in zip(["<s>", *x], x))
        return len(x), sum(self.words[w] > 0 for w in x), n, base, full


def is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def check(df, rows):
    plain = Plain([t for i, t in rows if not is_held_out(i)])
    got = sorted(df.collect(), key=lambda r: repr(tuple(r)[:4]))
    want = sorted(((i, is_held_out(i), *plain.row(t)) for i, t in rows), key=lambda r: repr(r[:4]))
    assert [tuple(r)[:5] for r in got] == [r[:5] for r in want]
    for r, w in zip(sorted(got, key=lambda r: (repr(tuple(r)[:4]), r.score)), sorted(want, key=lambda r: (repr(r[:4]), r[6]))):
        assert (r.base_score, r.score) == pytest.approx(w[5:], rel=1e-9, abs=1e-9)
        assert r.perplexity == pytest.approx(10 ** (-w[6] / w[2]), rel=1e-9)


@pytest.mark.parametrize("shards", [1, 5])
def test_scores_as_by_dictionaries(spark, odd, monkeypatch, shards):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    check(lm.score_all(odd, shards=shards), rows)


def test_small_tallies_and_chunks_change_nothing(spark, odd, monkeypatch):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    with staging(spark):
        learned = odd.where(~lm.held_out(odd["doc_id"]))
        model = lm.train(learned.repartition(7), shards=3)
        plain = Plain([t for i, t in rows if not is_held_out(i)])
        assert (model.words, model.pairs, model.tokens) == (len(plain.words), len(plain.pairs), sum(plain.words.values()))
        assert model.pair_discounts == pytest.approx(plain.dp) and model.word_discounts == pytest.approx(plain.dh)


def test_probabilities_add_up_to_one():
    texts = ["a b a c", "b b b a", "c a b d e a b", "a b"]
    plain = Plain(texts)
    for v in ["<s>", "a", "b", "unheard"]:
        assert sum(plain.chance(v, w) for w in [*plain.words, "unheard"]) == pytest.approx(1)


def test_nothing_to_learn_from(spark, nothing):
    assert lm.score_all(nothing).isEmpty()
    held = next(i for i in range(100) if is_held_out(i))
    (row,) = lm.score_all(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)


def test_tallies_merge_and_ship_sorted_blocks(monkeypatch):
    monkeypatch.setattr(lm, "TALLY", 50)
    rng = np.random.default_rng(3)
    held, keys = lm.Tally(4, lm._shard), rng.integers(0, 2**63, 300, dtype=np.uint64)
    batches = []
    for _ in range(6):
        batches += list(held.add(rng.choice(keys, 100)))
    batches += list(held.blocks())
    assert len(batches) > 4
    for shard, (found, counts) in lm._gathered(iter(batches)).items():
        assert (np.diff(found) > 0).all() and (lm._shard(found, 4) == shard).all()
    whole = [x for x in lm._gathered(iter(batches)).values()]
    assert sum(int(c.sum()) for _, c in whole) == 600
    assert isinstance(batches[0], pa.RecordBatch)
