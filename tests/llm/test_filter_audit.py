import itertools

import pytest

from plumbline.llm import filter_audit

SPACE = " \t\n\x0b\f\r"


def words_of(text):
    return "".join(" " if c in SPACE else c for c in text).split(" ")


def brute(docs, labels):
    """Rows of the report from (doc_id, text, lang) and (doc_id, quality, toxic), filter by filter."""
    failing = []
    for i, text, _ in docs:
        text = text or ""
        words = [w for w in words_of(text) if w]
        copy = i is not None and any(k is not None and k < i and (t or "") == text for k, t, _ in docs)
        capitals = sum("A" <= c <= "Z" for c in text)
        checks = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * capitals > 10 * len(text), any(c in "#$%&*|" for c in text), copy)
        failing.append({f for f, bad in zip("ABCDE", checks) if bad})
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = {}
    for part in {x or "" for _, _, x in docs}:
        own = [k for k, d in enumerate(docs) if (d[2] or "") == part]
        shares = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            alive = list(own)
            for step, f in enumerate(order, 1):
                gone = [k for k in alive if f in failing[k]]
                late = [k for k in own if f in failing[k] and k not in alive]
                alive = [k for k in alive if f not in failing[k]]
                lost = [sum(docs[k][0] in marked for k in gone) for marked in (good, toxic)]
                out[part, order, step] = [len(alive), len(gone), len(late), sum(failing[k] == {f} for k in own), *lost]
                shares[f] += len(gone)
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                out[part, order, step].append(shares[f])
    return out


def found(df):
    return {tuple(r)[:3]: list(tuple(r)[3:]) for r in df.collect()}


@pytest.fixture(scope="module")
def cases(odd):
    long = " ".join(f"w{k}" for k in range(150))
    rows = [(r.doc_id, r.text, r.lang) for r in odd.select("doc_id", "text", "lang").collect()]
    rows += [(100, long, "en"), (90, long, "de"), (101, long, None), (102, long.upper(), "en"), (103, long + " $", "en"), (104, "a # " * 200, "")]
    rows += [(105, long.upper() + " $", "de"), (106, long, "de"), (None, long, "fr"), (107, long + " of its own", "fr")]
    labels = [(100, 1, 0), (100, 0, 1), (102, 1, 1), (103, None, 1), (8, 1, None), (None, 1, 1), (104, 0, 0), (999, 1, 1), (106, 1, 0)]
    return rows, labels


def test_report_as_by_applying_every_order(spark, cases, monkeypatch):
    rows, labels = cases
    monkeypatch.setattr(filter_audit, "ROWS_PER_TASK", 7)
    monkeypatch.setattr(filter_audit, "CROWD", 2)  # every shared text is split
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'mine' AS id", "'mine' AS part", "'mine' AS toxic")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert found(filter_audit.audit(docs, marks)) == brute(rows, labels)


def test_no_documents_and_no_labels(spark, nothing):
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(nothing, no_labels).isEmpty()
    docs = spark.createDataFrame([(1, "A B", "x")], "doc_id long, text string, lang string")
    got = found(filter_audit.audit(docs, no_labels))
    assert len(got) == 600 and got["x", "ACBDE", 1] == [0, 1, 0, 0, 0, 0, 60] and got["x", "CABDE", 2] == [0, 0, 1, 0, 0, 0, 60]
