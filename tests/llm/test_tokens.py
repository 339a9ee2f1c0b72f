import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from plumbline.llm import packing, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PARTS = st.lists(
    st.sampled_from(["a", "The", "é", " ", "  ", "\n", "\r\n", "\t", "▁", "ing", "Z9", "12", "<s>", "<|endoftext|>", "　", "́", "J̌",
                     "ß", "日本", "😀", ".", "...", ";̸", "'s", "'S", "\x00", "Σ", "İ."])
).map("".join)


def test_counts_are_the_tokenizers_own(spark, odd, nothing):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for table_size in (1 << 16, 0):
        got = token_counts.count_tokens(odd, PIECES, table_size=table_size, limit=100).collect()
        want = [(r.doc_id, len((r.text or "").encode()), n := len(model.encode(r.text or "")), n > 100) for r in odd.collect()]
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert token_counts.count_tokens(nothing, PIECES).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert token_counts.count_tokens(nothing, PIECES).isEmpty()


@settings(max_examples=25, deadline=None)
@given(st.lists(PARTS, min_size=1, max_size=30))
def test_fields_add_up_to_the_text(texts):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    fields, counts, plain = token_counts.fields_of(pa.array(texts))
    sizes = np.array([len(x) for x in model.encode(fields.to_pylist())], int)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    stops = np.cumsum(counts)
    for i in np.flatnonzero(plain):
        assert ends[stops[i]] - ends[stops[i] - counts[i]] == len(model.encode(texts[i]))


@settings(max_examples=40, deadline=None)
@given(st.lists(PARTS, min_size=1, max_size=30))
def test_word_ids_add_up_to_the_text(texts):
    ids, counts = packing._coder(WORDS).encode(pa.array(texts))
    tokenizer = Tokenizer.from_file(WORDS)
    assert [list(x) for x in np.split(ids, np.cumsum(counts)[:-1])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_frequent_fields_are_those_of_all_documents(spark):
    rows = [(i, "first come first served") for i in range(1200)]
    rows += [(2000 + i, "last " * 20 + "again " * 10 + f"own{i}") for i in range(600)] + [(3000, "long " * 15_000 + "end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(3)
    assert token_counts.frequent_fields(docs, "text", 4).to_pylist() == ["long", "last", "again", "first"]
    # a summary of few fields still knows those that fill much of the table
    assert token_counts.frequent_fields(docs, "text", 2, 16).to_pylist() == ["long", "last"]
    counts = [pa.table({"field": ["a", "b", "c"], "n": [5, 3, 1]}), pa.table({"field": ["a", "d"], "n": [2, 1]})]
    assert sorted(token_counts._summary(counts, 2).to_pylist(), key=str) == [{"field": "a", "n": 6}, {"field": "b", "n": 2}]
    assert token_counts._summary(counts, 4).num_rows == 4


def check_packed(rows, documents, capacity):
    tokenizer = Tokenizer.from_file(WORDS)
    want = []
    for doc_id, text in documents:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for start in range(0, len(ids), capacity):
            part = ids[start : start + capacity]
            want.append((doc_id, start // capacity, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == sorted(want, key=repr)
    sequences: dict[int, list] = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_places_every_piece_once(spark, odd, nothing):
    for capacity in (64, 4096):
        rows = packing.pack(odd, WORDS, capacity=capacity).collect()
        n = check_packed(rows, [(r.doc_id, r.text) for r in odd.collect()], capacity)
        total = sum(r.length for r in rows)
        assert n <= -(-total // capacity) + 3
    assert packing.pack(nothing, WORDS).isEmpty()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_plan_is_tight(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(rng.lognormal(6, 1.2, 20_000).astype(int) + 1, 4096)
    counts = np.bincount(lengths, minlength=4097)
    plan = packing.packing_plan(counts)
    number = np.arange(len(lengths))
    run = np.searchsorted(plan["first"], number, "right") - 1
    rank, copies = number - plan["first"][run], plan["copies"][run]
    sequence, offset = plan["sequence"][run] + rank // copies, plan["offset"][run] + rank % copies * plan["length"][run]
    ordered = np.sort(lengths)
    assert (plan["length"][run] == ordered).all()
    order = np.lexsort((offset, sequence))
    ends = offset[order] + ordered[order]
    same = sequence[order][1:] == sequence[order][:-1]
    assert (offset[order][1:][same] == ends[:-1][same]).all() and ends.max() <= 4096
    assert len(np.unique(sequence)) <= 1.003 * -(-lengths.sum() // 4096) + 1


def test_nonnegative_least_squares_meets_its_conditions():
    rng = np.random.default_rng(5)
    matrix, target = rng.random((20, 40)), rng.random(20) * 10
    x = packing.nonnegative_least_squares(matrix, target)
    slope = matrix.T @ (target - matrix @ x)
    assert (x >= 0).all() and slope.max() < 1e-6 and abs(slope[x > 0]).max() < 1e-6
