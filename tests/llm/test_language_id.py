import random
import zlib

from plumbline.llm import language_id

COMMON = {"en": "the of and that with this from", "de": "der die und nicht auch sich mit", "fr": "les des une dans pour avec est"}


def corpus(spark):
    rng, rows = random.Random(3), []
    for i in range(300):
        lang = ("en", "de", "fr")[i % 3]
        rows.append((i, " ".join(rng.choice(COMMON[lang].split()) + rng.choice(["", "", "x"]) for _ in range(rng.randrange(3, 60))), lang))
    rows += [(900, None, "en"), (901, "12 !", "de"), (902, "", None), (None, "the of and that", None), (903, "der und nicht " * 40_000, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy_and_odd_rows(spark, odd, nothing):
    docs = corpus(spark)
    rows = language_id.identify(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    judged = [r for r in rows if r.held_out and r.doc_id < 300]
    assert sum(r.lang_pred == truth[r.doc_id] for r in judged) >= 0.97 * len(judged)
    found = {r.doc_id: r.lang_pred for r in rows}
    assert found[900] == found[901] == found[902] == "und" and found[903] == "de" and found[None] == "en"
    assert {r.lang_pred for r in language_id.identify(odd).collect()} <= {"und", "en", "de"}
    assert language_id.identify(nothing).isEmpty()
    unlabelled = language_id.identify(docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang"))
    assert {(r.lang_pred, r.score) for r in unlabelled.collect()} == {("und", 0.0)}


def test_labels_of_other_rows_never_matter(spark):
    docs = corpus(spark)
    changed = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 'xx' ELSE lang END AS lang")
    assert sorted(map(repr, language_id.identify(docs).collect())) == sorted(map(repr, language_id.identify(changed).collect()))


def test_rejection_keeps_columns(spark, odd):
    model = language_id.train(corpus(spark), "text", "lang", "doc_id")
    kept = language_id.keep_identified(odd, model)
    assert kept.columns == odd.columns
    assert all(r.text and any(c.isalpha() for c in r.text) for r in kept.collect())
