"""Token counts: a broadcast table of frequent pre-tokens, and caches in the workers.

The vocabulary has no piece that goes on after a space it does not begin with, so a text
breaks into fields at its single spaces and its tokens are those of the fields. Counting
is a lookup per distinct field of a slice of rows: first in a table of frequent fields
that the driver broadcasts, then in the worker's cache, and only then by the tokenizer.
The table comes from all documents: each task keeps a bounded summary of its fields
(Misra and Gries), and the sums of these are all that is shuffled. The table only saves
work: whatever it holds, the counts are the tokenizer's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import slices, texts_of

#: Fields in the broadcast table, and in the summary of a task (parameters of speed only).
TABLE_SIZE = 1 << 16
SUMMARY_SIZE = 1 << 17
#: A worker's cache is emptied beyond so many fields; longer fields are not kept.
CACHE_SIZE = 1 << 18
KEPT_LENGTH = 64

SPACE_MARK = "▁"


def open_model(path: str) -> sentencepiece.SentencePieceProcessor:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for piece in model.id_to_piece(list(range(model.get_piece_size()))):
        bare = piece.lstrip(SPACE_MARK)
        if SPACE_MARK in bare:
            raise ValueError(f"the piece {piece!r} crosses a space, so texts cannot be counted by field")
    return model


def fields_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The fields of all plain texts, how many each text has, and which texts are plain.

    A text is plain if each of its spaces stands alone between two fields; then every
    field is encoded as if it were a text of its own.
    """
    odd = pc.match_substring_regex(texts, f"^ |  | $|{SPACE_MARK}|^$")
    plain = pc.invert(odd)
    lists = pc.split_pattern(texts.filter(plain), " ")
    counts = np.zeros(len(texts), np.int64)
    mask = plain.to_numpy(zero_copy_only=False)
    counts[mask] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return lists.flatten(), counts, mask


def _summary(parts: list[pa.Table], size: int) -> pa.Table:
    """The sums of the counts by field; if over ``size`` fields, less the count of the first one too many."""
    held = pa.concat_tables(parts).group_by("field").aggregate([("n", "sum")]).rename_columns(["field", "n"])
    if held.num_rows <= size:
        return held
    counts = held.column("n").to_numpy()
    left = counts - np.partition(counts, -size - 1)[-size - 1]
    return pa.table({"field": held.column("field"), "n": pa.array(left)}).filter(pa.array(left > 0))


def frequent_fields(docs: DataFrame, text: str, size: int = TABLE_SIZE, summary: int = SUMMARY_SIZE) -> pa.Array:
    """The commonest fields of all ``docs``.

    A task forgets fields beyond ``summary`` of them, by at most one occurrence in
    ``summary`` of what it read; so a field that is more frequent than that overall is
    counted, and no count is too high.
    """
    if not size:
        return pa.array([], pa.string())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        for batch in slices(batches, "text"):
            fields = fields_of(texts_of(batch, "text"))[0]
            found = pc.value_counts(fields.filter(pc.less_equal(pc.utf8_length(fields), KEPT_LENGTH)))
            parts.append(pa.table({"field": found.field("values"), "n": found.field("counts")}))
            if sum(part.num_rows for part in parts) > 4 * summary:
                parts = [_summary(parts, summary)]
        if parts:
            yield from _summary(parts, summary).to_batches()

    counted = docs.select(F.col(text).alias("text")).mapInArrow(count, "field string, n bigint")
    top = counted.groupBy("field").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "field").limit(size)
    return pa.array([r[0] for r in top.select("field").collect()], pa.string())


def count_tokens(
    docs: DataFrame,
    model_path: str,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    limit: int = 4096,
    table_size: int = TABLE_SIZE,
) -> DataFrame:
    """The columns ``keep``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    One row per row of ``docs``. A null or empty text has 0 bytes and 0 tokens; repeated
    rows are counted each; texts of any length are counted whole; an empty table gives an
    empty one. Other columns of ``docs``, whatever their names, are left aside. Texts with
    doubled or outer spaces go to the tokenizer as they are.
    """
    spark = docs.sparkSession
    frequent = frequent_fields(docs, text, table_size)
    model = open_model(model_path)
    lengths = np.array([len(x) for x in model.encode(frequent.to_pylist(), num_threads=1)], np.uint16)
    shared = spark.sparkContext.broadcast((frequent, lengths))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = open_model(model_path)
        words, known = shared.value
        cache: dict[str, int] = {}
        for batch in slices(batches, "text"):
            texts = texts_of(batch, "text")
            fields, counts, plain = fields_of(texts)
            coded = fields.dictionary_encode()
            distinct = coded.dictionary
            size = np.zeros(len(distinct), np.int64)
            if len(words):
                at = pc.index_in(distinct, value_set=words)
                hit = at.is_valid().to_numpy(zero_copy_only=False)
                size[hit] = known[at.drop_null().to_numpy()]
            else:
                hit = np.zeros(len(distinct), bool)
            rest = np.flatnonzero(~hit)
            missing = distinct.take(pa.array(rest)).to_pylist()
            new = [w for w in missing if w not in cache]
            fetched = dict(zip(new, map(len, worker.encode(new, num_threads=1)))) if new else {}
            size[rest] = [n if (n := cache.get(w)) is not None else fetched[w] for w in missing]
            if len(cache) + len(fetched) > CACHE_SIZE:
                cache = {}
            cache.update((w, n) for w, n in fetched.items() if len(w) <= KEPT_LENGTH)
            ends = np.concatenate([[0], np.cumsum(size[coded.indices.to_numpy()])])
            stops = np.cumsum(counts)
            n_tokens = ends[stops] - ends[stops - counts]
            for i in np.flatnonzero(~plain):
                n_tokens[i] = len(worker.encode(texts[int(i)].as_py(), num_threads=1))
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(f"keep{i}") for i in range(len(keep))],
                    pc.binary_length(texts).cast(pa.int64()),
                    pa.array(n_tokens, pa.int64()),
                    pa.array(n_tokens > limit),
                ],
                [*keep, "n_bytes", "n_tokens", "over_limit"],
            )

    narrow = docs.select(*[F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)], F.col(text).alias("text"))
    head = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return narrow.mapInArrow(count, ", ".join([*head, "n_bytes bigint", "n_tokens bigint", "over_limit boolean"]))
