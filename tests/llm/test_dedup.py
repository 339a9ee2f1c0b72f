import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from plumbline.llm import jaccard_join, line_dedup, suffix_dedup

# -- lines ----------------------------------------------------------------------------


def plain(line):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), line)
    return re.sub("[ \t\n\x0b\f\r]+", " ", low).strip(" ")


def close(a, b):
    if a == b:
        return True
    if min(len(a), len(b)) < line_dedup.MIN_NEAR or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_lines(rows):
    lines = sorted({(i, no, plain(line)) for i, t in rows if t is not None for no, line in enumerate(t.split("\n"))})
    gone = set()
    for k, (i, no, line) in enumerate(lines):
        if line and any(close(line, other) for _, _, other in lines[:k] if other):
            gone.add((i, no))
    return sorted(((i, None if t is None else "\n".join(x for no, x in enumerate(t.split("\n")) if (i, no) not in gone)) for i, t in rows), key=repr)


def test_lines_as_by_brute_force(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(n)).strip() for n in (19, 20, 21, 33, 64, 65, 100, 1500)] + ["", " ", "short"]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            line, at = rng.choice(base), rng.randrange(100)
            kind = rng.randrange(5)
            at = at % max(len(line), 1)
            lines.append([line, line[:at] + "é" + line[at + 1 :], line[:at] + line[at + 1 :], line[:at] + "Ü" + line[at:], line.upper() + "  "][kind])
        rows.append((i, "\n".join(lines)))
    rows += [(200, None), (201, ""), rows[3], (202, "last\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, line_dedup.dedup_lines(docs).collect()), key=repr)
    assert got == brute_lines(rows)


def test_lines_of_odd_rows(spark, odd, nothing):
    left = line_dedup.dedup_lines(odd)
    assert left.columns == odd.columns and left.count() == odd.count()
    assert {r.text for r in left.where("doc_id = 0").collect()} == {None}
    assert line_dedup.dedup_lines(nothing).isEmpty() and line_dedup.line_report(nothing).isEmpty()


# -- similar documents ----------------------------------------------------------------


def shingle_set(text):
    w = [x for x in re.split("[ \t\n\x0b\f\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


def brute_groups(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    label = list(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            old, new = label[b], label[a]
            label = [new if k == old else k for k in label]
    low = {}
    for (i, _), k in zip(sets, label):
        low[k] = min((v for v in (low.get(k), i) if v is not None), default=None)
    return sorted(((i, len(s), low[k]) for (i, s), k in zip(sets, label)), key=repr)


@pytest.mark.parametrize("crowd", [2, 32])
def test_groups_as_by_brute_force(spark, odd, crowd):
    rng = random.Random(9)
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect() if r.doc_id is not None]
    for g in range(4):
        base = [f"{rng.choice('abcdefgh')}{rng.randrange(60)}" for _ in range(80)]
        for i in range(25):
            own = list(base)
            for _ in range(rng.randrange(7)):
                own[rng.randrange(len(own))] = f"new{rng.randrange(1000)}"
            rows.append((1000 + 100 * g + i, " ".join(own[: rng.randrange(60, 81)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.near_duplicates(docs, crowd=crowd).drop("key").collect()
    assert sorted(map(tuple, got), key=repr) == brute_groups(rows)


def brute_partners(known):
    lists = {}
    for token, cid, n, k, label, leading in known:
        lists.setdefault(cid, (n, k, label, set()))[3].add(token)
    out = set()
    for a, b in itertools.combinations(sorted(lists), 2):
        (na, ka, la, ta), (nb, kb, lb, tb) = lists[a], lists[b]
        if la != lb and len(ta & tb) >= min(ka, kb) and 4 * min(na, nb) >= 3 * max(na, nb):
            out.add((a, b))
    return out


def test_partners_share_lists_of_either_leader(spark):
    schema = "token long, cid long, n long, k long, label long, leading boolean"
    # two crowded labels; 7 and 107 share two lists led by the one and two led by the other
    rows = [(t, c, 90, 4, label, label == lead) for lead, tokens in ((1, (1, 2)), (101, (3, 4))) for t in tokens
            for c, label in [(lead + i, lead) for i in range(40)] + [(107 if lead == 1 else 7, 102 - lead)]]
    assert {tuple(r) for r in jaccard_join._partners(spark.createDataFrame(rows, schema)).collect()} == brute_partners(rows) == {(7, 107)}
    rng = random.Random(3)
    facts = {c: (rng.randrange(70, 100), rng.choice([1, 2, 4, 6, 32]), rng.choice([1, 2, 3, c])) for c in range(1, 90)}
    rows = []
    for token in range(120):
        lead = rng.choice([1, 2, 3, rng.randrange(4, 90)])
        rows += [(token, c, *facts[c], facts[c][2] == facts[lead][2]) for c in {lead, *rng.sample(sorted(facts), rng.randrange(1, 40))}]
    want = brute_partners(rows)
    assert {tuple(r) for r in jaccard_join._partners(spark.createDataFrame(rows, schema)).collect()} == want and len(want) > 100


def test_near_copies_below_the_threshold_make_few_pairs(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(160):
        own = list(base)
        for _ in range(6):
            own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    sizes, stage = [], jaccard_join.stage

    def counted(df, name, outer=False):
        out = stage(df, name, outer)
        sizes.append(out.count() if name == "pairs" else 0)
        return out

    monkeypatch.setattr(jaccard_join, "stage", counted)
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).drop("key").collect()
    assert sorted(map(tuple, got), key=repr) == brute_groups(rows)
    assert max(sizes) < 160 * 159 // 2 // 10


def test_a_large_group_is_joined_by_few_links(spark, monkeypatch):
    rng = random.Random(12)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(320):  # about half of all pairs are similar enough, so leaders leave many members out
        own = list(base)
        for at in rng.sample(range(150), rng.choice([2, 3, 4])):
            own[at] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    sizes, stage = [], jaccard_join.stage

    def counted(df, name, outer=False):
        out = stage(df, name, outer)
        sizes.append(out.count() if name in ("pairs", "links") else 0)
        return out

    monkeypatch.setattr(jaccard_join, "stage", counted)
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).drop("key").collect()
    assert sorted(map(tuple, got), key=repr) == brute_groups(rows)
    assert sum(sizes) < 14 * 320


def test_members_of_one_label_make_no_pairs(spark):
    rng = random.Random(5)
    rows = [(t, c, 90, 8, 1 if c < 180 else c, c < 180 and t < 12) for c in range(1, 201) for t in rng.sample(range(24), 16)]
    known = spark.createDataFrame(rows, "token long, cid long, n long, k long, label long, leading boolean")
    want = brute_partners(rows)
    assert {tuple(r) for r in jaccard_join._partners(known).collect()} == want
    some = {tuple(r) for r in jaccard_join._partners(known, nearest=2).collect()}
    assert some and some <= want and len(some) <= 2 * 200


def test_a_long_list_is_sent_once_a_block(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(t, c, 100, 12, c, False) for c in range(1, 501) for t in rng.sample(range(24), 18)]
    known = spark.createDataFrame(rows, "token long, cid long, n long, k long, label long, leading boolean")
    entries, stage = {}, jaccard_join.stage

    def counted(df, name, outer=False):
        out = stage(df, name, outer)
        if name == "sent":
            entries[name] = out.selectExpr("sum(size(cids))").first()[0]
        return out

    monkeypatch.setattr(jaccard_join, "stage", counted)
    assert {tuple(r) for r in jaccard_join._partners(known).collect()} == brute_partners(rows)
    blocks = 24 + 500 // jaccard_join.BLOCK  # at most one not full for each home
    assert len(rows) <= entries["sent"] <= len(rows) * blocks < len(rows) * 500


def test_pairs_of_the_least_similarity_are_kept(spark):
    rng = random.Random(6)
    rows = []
    for g in range(60):  # two texts that share a run of words and differ at the ends, on either side of three quarters
        shared, own = rng.randrange(30, 90), [rng.randrange(1, 18) for _ in range(2)]
        run = [f"g{g}s{k}" for k in range(shared)]
        rows += [(2 * g + i, " ".join(run + [f"g{g}x{i}n{k}" for k in range(own[i])])) for i in range(2)]
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).drop("key").collect()
    want = brute_groups(rows)
    assert sorted(map(tuple, got), key=repr) == want and 60 < len({r[2] for r in want}) < 120


def test_first_of_each_group_stays(spark, odd, nothing):
    kept = jaccard_join.keep_first_of_groups(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(0) == 2 and 9 not in ids and 10 in ids and ids.count(8) == 1  # only ASCII letters lose their case
    assert jaccard_join.keep_first_of_groups(nothing).isEmpty()


def test_prefix_choice_trades_length_for_matches():
    assert jaccard_join.prefix_lengths(np.zeros(100)) == (1, 26)
    k, length = jaccard_join.prefix_lengths(np.concatenate([np.zeros(20), np.full(80, 500.0)]))
    assert k > 1 and length == 25 + k
    assert jaccard_join.prefix_lengths(np.zeros(1)) == (1, 1)


# -- repeated bytes -------------------------------------------------------------------


def brute_bytes(rows, length, keep_first):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen: dict[bytes, list] = {}
    for row, (_, b) in enumerate(raw):
        for k in range(len(b) - length + 1):
            seen.setdefault(b[k : k + length], []).append((row, k))
    out = []
    for row, (i, b) in enumerate(raw):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            places = seen[b[k : k + length]]
            if len(places) > 1 and not (keep_first and places[0] == (row, k)):
                gone[k : k + length] = True
        left = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("crowd", [1, 4000])
def test_bytes_as_by_brute_force(spark, keep_first, crowd):
    rng = random.Random(6)
    passages = ["".join(rng.choice("abcdéf ") for _ in range(n)) for n in (39, 40, 55, 120, 400)]
    rows = []
    for i in range(40):
        parts = [rng.choice(passages)[rng.randrange(4) :] if rng.random() < 0.6 else "".join(rng.choice("abcdef ") for _ in range(50)) for _ in range(rng.randrange(6))]
        rows.append((i, "".join(parts)))
    rows += [(90, None), (91, ""), (92, "ab" * 150), (93, "x" * 39), (94, "日本" * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.removal_report(docs, length=40, gram=8, keep_first=keep_first, crowd=crowd).collect()
    assert sorted(map(tuple, got), key=repr) == brute_bytes(rows, 40, keep_first)


def test_bytes_of_odd_rows(spark, odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = suffix_dedup.removal_report(odd, keep_first=False).collect()
    assert sorted(map(tuple, got), key=repr) == brute_bytes(rows, 400, False)
    left = {r.doc_id: r.text for r in suffix_dedup.dedup_text(odd).collect()}
    assert left[4] == "word" and left[9] == "" and left[0] == ""
    assert suffix_dedup.removal_report(nothing).isEmpty()


def test_suffix_order_finds_runs():
    owner, inner, run = suffix_dedup.repeated_starts([b"abcdefghij", b"xxabcdefghi", b"abcdefghi"], 9)
    assert sorted(zip(owner.tolist(), inner.tolist())) == [(0, 0), (1, 2), (2, 0)] and len(set(run.tolist())) == 1


def test_text_beyond_one_part(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART", 64)
    text = bytes(random.Random(2).choices(range(97, 110), k=1000))
    found = list(suffix_dedup.stretches(text, 40, 8))
    assert sorted(s for _, _, low, high in found for s in range(low, high + 1)) == list(range(961))
