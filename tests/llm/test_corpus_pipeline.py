import corpus_pipeline
import public_tokenizers
from test_decontamination import brute
from test_dedup import brute_groups, brute_lines
from test_tokens import check_packed

from plumbline.llm import language_id


def test_stages_as_by_brute_force(spark, odd, nothing, folder):
    words = [" ".join(f"{p}{i * k % 97}" for i in range(1, 60)) for k, p in enumerate(("the", "of", "and"), 3)]
    rows = [(i, words[i % 3] + f"\nown line number {i * 7919} of this document", "en", "s", 1) for i in range(30)]
    passage = " ".join(f"test{i}" for i in range(20))
    rows += [(50, passage + " and a little more", "en", "s", 1), (51, None, "en", "s", 1), (52, "", None, None, None), (53, "1 2 3", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    benchmark = spark.createDataFrame([(1, passage)], "item_id long, text string")
    docs.write.parquet(f"{folder}/documents.parquet")
    benchmark.write.parquet(f"{folder}/benchmark.parquet")

    left = [(r[0], r[1]) for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    left = brute_lines(left)
    groups = {i: c for i, _, c in brute_groups(left)}
    left = [(i, t) for i, t in left if groups[i] == i]
    left = [(i, t) for i, t in left if not brute(t, [(1, passage)])[-1]]
    check_packed(corpus_pipeline.run(spark, folder).collect(), left, 4096)
    step = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, folder)
        assert step.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in step.collect()) == sorted(left)


def test_copies_do_not_go_on_as_empty_documents(spark):
    text = "a line of the first document, with some words\n\nand another line of it"
    rows = [(1, text), (2, text), (3, text), (None, "no id\nat all"), (9, "no id\nat all"), (4, text + "\nand one of its own"), (5, ""), (6, " \n"), (7, None), (8, text), (8, text)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "mine") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, had_words string")
    left = corpus_pipeline.cut_repeated_lines(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == [(0, "no id\nat all"), (1, text), (4, "\nand one of its own"), (5, ""), (6, " \n"), (7, None)]


def test_empty_and_odd_tables_pass(spark, odd, nothing, folder):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for docs in (nothing, odd):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, folder)
        docs.collect()


def test_five_stages_of_the_public_tokenizer():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "decontamination", "packing"]
    assert public_tokenizers.path("word_bpe_49k.json") and language_id.UNKNOWN == "und"
