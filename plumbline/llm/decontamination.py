"""Benchmark decontamination: a broadcast set of hashed test n-grams, scanned by window.

The benchmark's word windows are hashed and broadcast; token windows of whole documents
are looked up by hash, hits are verified word by word, and the words that they cover are
counted, cut out, or taken as reason to drop the document. Documents are not shuffled.

A set of windows beyond ``BLOCK_WINDOWS`` is broadcast block by block: each pass adds its
hits to two columns that travel with the document, so no broadcast grows with the data.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.common import flat_bytes, fresh, slices, texts_of
from plumbline.plans.cutting import stage

WINDOW = 13
#: Words of the benchmark that one broadcast holds at most.
BLOCK_WINDOWS = 2_000_000
_BITS = 22
_WORD = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")

#: A-Z to a-z; every other ASCII character that is no letter or digit to a space.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


class Words:
    """The folded words of many texts: their places in one buffer, and a hash of each."""

    def __init__(self, texts: pa.Array, fold: bytes = FOLD):
        raw, offsets = flat_bytes(texts)
        # one space after each text keeps the words of neighbours apart
        spread = np.full(len(raw) + len(texts), 32, np.uint8)
        spread[np.arange(len(raw)) + np.repeat(np.arange(len(texts)), np.diff(offsets))] = raw
        self.buffer = spread.tobytes().translate(fold)
        folded = np.frombuffer(self.buffer, np.uint8)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], folded != 32, [False]]).astype(np.int8)))
        self.starts, self.ends = edges[::2], edges[1::2]
        limits = offsets[1:] + np.arange(1, len(texts) + 1)
        self.stops = np.searchsorted(self.starts, limits)  # words of text i end here
        self.firsts = np.concatenate([[0], self.stops[:-1]])
        self.hashes = np.zeros(len(self.starts), np.uint64)
        length, done = self.ends - self.starts, 0
        live = np.arange(len(self.starts))
        while len(live):  # byte by byte of all words that are that long
            self.hashes[live] = (self.hashes[live] * _BASE + _BYTE[folded[self.starts[live] + done]]) ^ (self.hashes[live] >> np.uint64(29))
            done += 1
            live = live[length[live] > done]

    def windows(self, size: int) -> np.ndarray:
        """Hash of the ``size`` words from each word on, whatever text they belong to."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        total = np.zeros(n, np.uint64)
        for k in range(size):
            total = total * _STEP + self.hashes[k : k + n]
        return (total ^ (total >> np.uint64(32))) * _MIX

    def phrase(self, first: int, size: int) -> bytes:
        """The words themselves, a space between them."""
        return b" ".join(self.buffer[s:e] for s, e in zip(self.starts[first : first + size], self.ends[first : first + size]))


class WindowSet:
    """Hashed windows of test items, with the words of each to verify a hit."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        phrases: dict[int, dict[bytes, set[str]]] = {}
        words = Words(pa.array([text for _, text in items], pa.string()))
        hashes: dict[int, list[int]] = {}
        by_size = {}
        for k, (item, _) in enumerate(items):
            first, n = int(words.firsts[k]), int(words.stops[k] - words.firsts[k])
            own = min(size, n)
            if not own:
                continue
            if own not in by_size:
                by_size[own] = words.windows(own)
            for at in range(first, first + n - own + 1):
                h = int(by_size[own][at])
                hashes.setdefault(own, []).append(h)
                phrases.setdefault(own, {}).setdefault(words.phrase(at, own), set()).add(item)
        self.phrases = {own: {p: sorted(ids) for p, ids in found.items()} for own, found in phrases.items()}
        self.hashes = {own: np.unique(np.array(hs, np.uint64)) for own, hs in hashes.items()}

    def hits(self, words: Words) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, words, items) of each verified window occurrence."""
        for size, known in self.hashes.items():
            found = words.windows(size)
            bits = np.zeros(1 << _BITS, bool)
            bits[(known >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            likely = np.flatnonzero(bits[(found >> np.uint64(64 - _BITS)).astype(np.int64)])
            at = np.minimum(np.searchsorted(known, found[likely]), len(known) - 1)
            likely = likely[known[at] == found[likely]]
            # a window that runs over the end of its text is none
            owner = np.searchsorted(words.stops, likely, "right")
            for first in likely[likely + size <= words.stops[owner]] if len(likely) else []:
                items = self.phrases[size].get(words.phrase(int(first), size))
                if items:
                    yield int(first), size, items


def _blocks(benchmark: DataFrame, item_id: str, text: str, limit: int) -> Iterator[list[tuple[str, str]]]:
    """Items in lists of at most ``limit`` words (an item with more is a list of its own)."""
    rows = benchmark.select(F.col(item_id).cast("string"), F.col(text)).where(F.col(text).isNotNull())
    block, size = [], 0
    for item, words in rows.toLocalIterator():
        n = len(_WORD.findall(words))
        if block and size + n > limit:
            yield block
            block, size = [], 0
        block.append((item or "", words))
        size += n
    yield block


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_windows: int = BLOCK_WINDOWS,
    names: tuple[str, str, str] = ("n_words", "hit_spans", "hit_items"),
) -> DataFrame:
    """``docs`` with the number of words, the spans of words hit and the items that hit.

    ``hit_spans`` is a flat array first, end, first, end ... of maximal runs of hit words;
    ``hit_items`` holds the distinct item ids as strings, sorted. A null text has no
    words. Items without words hit nothing; several items may share a window. All rows of
    ``docs`` and all its columns stay; ``names`` are changed if ``docs`` has such columns.
    """
    count, spans, items = fresh(docs, *names)
    columns = docs.columns
    out = docs.select(
        *[F.col(f"`{c}`") for c in columns],
        F.lit(0).cast("bigint").alias(count),
        F.array().cast("array<bigint>").alias(spans),
        F.array().cast("array<string>").alias(items),
    )
    for k, block in enumerate(_blocks(benchmark, item_id, item_text, block_windows)):
        if k:
            out = stage(out, "hits")
        shared = docs.sparkSession.sparkContext.broadcast(block)
        out = out.mapInArrow(_scan(shared, text, window, count, spans, items), out.schema)
    return out


def _scan(shared, text: str, window: int, count: str, spans: str, items: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WindowSet(shared.value, window)
        for batch in slices(batches, text):
            words = Words(texts_of(batch, text))
            found: dict[int, list[tuple[int, int, list[str]]]] = {}
            for first, size, ids in known.hits(words):
                row = int(np.searchsorted(words.stops, first, "right"))
                at = first - int(words.firsts[row])
                found.setdefault(row, []).append((at, at + size, ids))
            new_spans, new_items = batch.column(spans).to_pylist(), batch.column(items).to_pylist()
            for row, hits in found.items():
                new_items[row] = sorted({*new_items[row], *(i for _, _, ids in hits for i in ids)})
                old = list(zip(new_spans[row][::2], new_spans[row][1::2]))
                merged: list[list[int]] = []
                for low, high in sorted([*old, *((a, b) for a, b, _ in hits)]):
                    if merged and low <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], high)
                    else:
                        merged.append([low, high])
                new_spans[row] = [x for pair in merged for x in pair]
            made = {
                count: pa.array(words.stops - words.firsts, pa.int64()),
                spans: pa.array(new_spans, pa.list_(pa.int64())),
                items: pa.array(new_items, pa.list_(pa.string())),
            }
            arrays = [made.get(n, c) for n, c in zip(batch.schema.names, batch.columns)]
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names)

    return scan


def _n_hit(spans: str) -> Column:
    return F.aggregate(F.col(spans), F.lit(0).cast("bigint"), lambda total, x: x - total)


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated`` of every row.

    A document is contaminated if at least a twentieth of its words are hit.
    """
    text = options.get("text", "text")
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = benchmark_hits(narrow, benchmark, **(options | {"text": "text"}))
    n_hit = _n_hit("hit_spans")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, unchanged."""
    found = benchmark_hits(docs, benchmark, **options)
    count, spans, _ = found.columns[len(docs.columns) :]
    n_hit = _n_hit(spans)
    return found.where(~((n_hit > 0) & (20 * n_hit >= F.col(count)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def cut_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """All rows of ``docs``, with the hit words cut out of the text.

    A run of hit words goes with what stands between them; what stands around it stays.
    """
    found = benchmark_hits(docs, benchmark, text=text, **options)
    _, spans, _ = found.columns[len(docs.columns) :]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            texts, runs = batch.column(text).to_pylist(), batch.column(spans).to_pylist()
            for row, run in enumerate(runs):
                if run:
                    raw = texts[row].encode()
                    words = Words(pa.array([texts[row]]))
                    for first, end in list(zip(run[::2], run[1::2]))[::-1]:
                        raw = raw[: words.starts[first]] + raw[words.ends[end - 1] :]
                    texts[row] = raw.decode()
            at = batch.schema.get_field_index(text)
            arrays = [*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1 :]]
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names)

    return found.mapInArrow(cut, found.schema).select(*[F.col(f"`{c}`") for c in docs.columns])


def items_digest(items: list[str]) -> str:
    """What ``items_sha256`` holds for those items."""
    return hashlib.sha256(",".join(sorted(set(items))).encode()).hexdigest()
