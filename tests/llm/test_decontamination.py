import re

from plumbline.llm import decontamination as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    own, hit, met = words(text), set(), set()
    for item, body in items:
        w = words(body)
        size = min(13, len(w))
        for k in range(len(w) - size + 1) if size else ():
            for at in range(len(own) - size + 1):
                if own[at : at + size] == w[k : k + size]:
                    hit |= set(range(at, at + size))
                    met.add(str(item))
    return len(own), len(hit), len(met), d.items_digest(list(met)), bool(hit) and 20 * len(hit) >= len(own)


def items(spark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(1, long), (2, long), (3, "short item"), (4, None), (5, " ?! "), (6, " ".join(f"W{i}," for i in range(10, 24))), (None, "naïve été")]
    return spark.createDataFrame(rows, "item_id long, text string")


def table(spark, odd):
    passage = " ".join(f"w{i}" for i in range(3, 20))
    more = [(100, "before " + passage + " after"), (101, "filler " * 400 + passage), (102, "A SHORT, item!"), (103, "x " * 60 + "short item"), (104, "naïve -- été")]
    return odd.select("doc_id", "text", "lang", "key", "n_words").union(spark.createDataFrame([(*r, "en", "mine", "mine") for r in more], "doc_id long, text string, lang string, key string, n_words string"))


def test_same_as_brute_force_in_one_block_or_many(spark, odd, nothing):
    docs, benchmark = table(spark, odd), items(spark)
    rows = [(None if r.item_id is None else r.item_id, r.text) for r in benchmark.collect()]
    rows = [("" if i is None else i, t) for i, t in rows]
    want = sorted(((r.doc_id, *brute(r.text, rows)) for r in docs.collect()), key=repr)
    for block in (2_000_000, 25):
        assert sorted(map(tuple, d.contamination(docs, benchmark, block_windows=block).collect()), key=repr) == want
    assert any(r[-1] for r in want) and not all(r[-1] for r in want if r[2])
    assert d.contamination(nothing, benchmark).isEmpty()
    assert {r.n_hit for r in d.contamination(docs, benchmark.where("false")).collect()} == {0}


def test_dropping_and_cutting_keep_columns(spark, odd):
    docs, benchmark = table(spark, odd), items(spark)
    bad = {r.doc_id for r in d.contamination(docs, benchmark).collect() if r.contaminated}
    kept = d.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(map(repr, kept.collect())) == sorted(repr(r) for r in docs.collect() if r.doc_id not in bad)
    cut = {r.doc_id: r.text for r in d.cut_spans(docs, benchmark).collect()}
    assert cut[100] == "before  after" and cut[102] == "A !" and cut[104] == "" and cut[0] is None
