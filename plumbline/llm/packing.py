"""Best-fit packing: length patterns fitted to the histogram by non-negative least squares.

1. Texts become token ids, and pieces of at most ``capacity`` tokens (no shuffle; the
   pieces are staged without their ids).
2. The driver gets the histogram of piece lengths: at most ``capacity`` numbers.
3. Patterns of up to three length classes that fill a sequence are enumerated; repeat
   counts are fitted to the histogram by non-negative least squares and rounded down.
   All but the smallest class of a pattern are filled with real lengths; the smallest,
   and what the rounding left over, is packed best-fit, longest first, into the space
   the patterns leave and then into new sequences, so that classes waste nothing. All of this works on counts of lengths, never on documents.
4. Pieces are numbered in order of length; the plan is a list of runs in that order, so
   each piece finds its place by binary search.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from plumbline.llm.common import ranges, slices, texts_of
from plumbline.operators.numbering import number_rows
from plumbline.plans.cutting import stage

CAPACITY = 4096
END_ID = 1
#: Length classes per sequence in the fit, and documents in a pattern.
CLASSES = 64
#: Weight of classes shorter than 1/SHORT of a sequence in the fit: they fill gaps later.
SHORT, SHORT_WEIGHT = 16, 0.1
#: Words whose ids a worker keeps, and bytes of text it encodes together.
CACHE_SIZE, SLICE = 1_000_000, 2_000_000


class WordCoder:
    """Token ids of many texts at once, each distinct word encoded once.

    The tokenizer drops white space and splits at it, so a text's ids are those of its
    words (runs without ASCII white space), joined. It also splits between a letter or
    digit and the punctuation after it, so that is taken off first; and case is dropped,
    so ASCII words are looked up in lower case.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._forget()

    def _forget(self) -> None:
        self._slots: dict[str, int] = {}
        self._pool = np.zeros(0, np.uint32)
        self._starts = self._sizes = np.zeros(0, np.int64)

    def _known(self, words: list[str]) -> np.ndarray:
        """The slot of each word, of which new ones get one."""
        if len(self._slots) + len(words) > CACHE_SIZE:
            self._forget()
        new = list(dict.fromkeys(w for w in words if w not in self._slots))
        ids = []
        for at in range(0, len(new), 10_000):  # results of the tokenizer are large
            ids += [e.ids for e in self._tokenizer.encode_batch_fast(new[at : at + 10_000], add_special_tokens=False)]
        sizes = np.array([len(x) for x in ids], np.int64)
        total = int(sizes.sum())
        self._starts = np.concatenate([self._starts, len(self._pool) + np.cumsum(sizes) - sizes])
        self._sizes = np.concatenate([self._sizes, sizes])
        self._pool = np.concatenate([self._pool, np.fromiter(chain.from_iterable(ids), np.uint32, total)])
        self._slots.update(zip(new, range(len(self._slots), len(self._slots) + len(new))))
        return np.fromiter((self._slots[w] for w in words), np.int64, len(words))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row as uint32, and the number of ids of each text."""
        apart = pc.replace_substring_regex(texts, r"([0-9A-Za-zÀ-ÖØ-öø-ÿ])([.,;:!?])", r"\1 \2")
        lists = pc.ascii_split_whitespace(apart)
        coded = lists.flatten().dictionary_encode()
        words = [w.lower() if w.isascii() and "<" not in w else w for w in coded.dictionary.to_pylist()]
        at = self._known(words)[coded.indices.to_numpy()]
        counts = self._sizes[at]
        ids = self._pool[ranges(self._starts[at], counts)]
        ends = np.concatenate([[0], np.cumsum(counts)])
        stops = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
        return ids, np.diff(ends[np.concatenate([[0], stops])])


@cache
def _coder(path: str) -> WordCoder:
    """One for all tasks of a worker process, so that its words outlive a task."""
    return WordCoder(path)


def token_pieces(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` of every piece of every document.

    A null or empty text is the closing id alone. Every row of ``docs`` counts, repeated
    or not; other columns are left aside.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(tokenizer_path)
        for batch in slices(batches, "text", SLICE):
            ids, sizes = coder.encode(texts_of(batch, "text"))
            base = np.cumsum(sizes) - sizes
            full = sizes + 1
            pieces = -(-full // capacity)
            row = np.repeat(np.arange(len(sizes)), pieces)
            number = ranges(np.zeros(len(sizes), np.int64), pieces)
            start = number * capacity
            length = np.minimum(full[row] - start, capacity)
            raw, end = ids.astype("<u4").tobytes(), np.array([END_ID], "<u4").tobytes()
            crc = []
            for r, s, n in zip(row, start, length):
                first = int(base[r] + s)
                closing = s + n == full[r]
                value = zlib.crc32(raw[4 * first : 4 * (first + int(n) - closing)])
                crc.append(zlib.crc32(end, value) if closing else value)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(row)),
                    pa.array(number, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(
        cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


# -- the plan, on counts of lengths ---------------------------------------------------


def class_patterns(classes: int) -> list[tuple[int, ...]]:
    """All ways to fill ``classes`` units with one, two or three class sizes, largest first."""
    found: list[tuple[int, ...]] = [(classes,)]
    found += [(classes - b, b) for b in range(1, classes // 2 + 1)]
    for c in range(1, classes // 3 + 1):
        found += [(classes - b - c, b, c) for b in range(c, (classes - c) // 2 + 1)]
    return found


def nonnegative_least_squares(matrix: np.ndarray, target: np.ndarray) -> np.ndarray:
    """x >= 0 with least ``|matrix x - target|``, by the active-set method of Lawson and Hanson."""
    x = np.zeros(matrix.shape[1])
    passive = np.zeros(matrix.shape[1], bool)
    slope = matrix.T @ target
    tolerance = 1e-9 * max(1.0, float(np.abs(slope).max(initial=0)))
    for _ in range(3 * matrix.shape[1]):
        if passive.all() or (free := np.where(passive, -np.inf, slope)).max() <= tolerance:
            break
        passive[int(free.argmax())] = True
        while True:
            trial = np.zeros_like(x)
            trial[passive] = np.linalg.lstsq(matrix[:, passive], target, rcond=None)[0]
            if trial[passive].min(initial=1) > 0:
                break
            low = passive & (trial <= 0)
            step = (x[low] / np.maximum(x[low] - trial[low], 1e-300)).min()
            x += step * (trial - x)
            passive &= x > tolerance * 1e-3
            x[~passive] = 0
            if not passive.any():
                trial = np.zeros_like(x)
                break
        x = trial
        slope = matrix.T @ (target - matrix @ x)
    return x


def fitted_counts(counts: np.ndarray, capacity: int, classes: int) -> list[tuple[tuple[int, ...], int]]:
    """Class patterns with their rounded repeat counts, never more than the histogram holds."""
    unit = -(-capacity // classes)
    classes = -(-capacity // unit)
    histogram = np.zeros(classes + 1)
    for length in np.flatnonzero(counts):
        histogram[-(-length // unit)] += counts[length]
    patterns = class_patterns(classes)
    matrix = np.zeros((classes, len(patterns)))
    for k, pattern in enumerate(patterns):
        for size in pattern:
            matrix[size - 1, k] += 1
    weight = np.where(np.arange(1, classes + 1) * SHORT <= classes, SHORT_WEIGHT, 1.0)
    repeats = nonnegative_least_squares(matrix * weight[:, None], histogram[1:] * weight)
    left, chosen = histogram[1:].astype(np.int64), []
    for k in sorted(range(len(patterns)), key=lambda k: (-repeats[k], k)):
        need = matrix[:, k].astype(np.int64)
        n = min(int(repeats[k] + 1e-6), *(int(left[i] // need[i]) for i in np.flatnonzero(need)))
        if n > 0:
            left -= n * need
            chosen.append((patterns[k], n))
    return chosen


def packing_plan(counts: np.ndarray, capacity: int = CAPACITY, classes: int = CLASSES) -> dict[str, np.ndarray]:
    """Where the pieces go that are numbered 0, 1, ... in order of length.

    ``counts[n]`` is the number of pieces of length n. The result lists runs: from number
    ``first`` on, ``copies`` pieces after each other share a sequence, beginning at
    ``offset`` in sequence ``sequence``; the next ones go to the sequence after it.
    """
    counts = np.asarray(counts, np.int64).copy()
    firsts = np.cumsum(counts) - counts
    used = np.zeros_like(counts)
    unit = -(-capacity // classes)
    # bins by free space: lists of (layout, number), a layout being runs of (length, copies)
    bins: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    left = counts.copy()
    for pattern, repeats in fitted_counts(counts, capacity, classes):
        slots = []
        for size in pattern[:-1] or pattern:  # the longest pieces of the class that are left, as runs
            runs, need = [], repeats
            for length in range(min(size * unit, capacity), (size - 1) * unit, -1):
                take = min(need, int(left[length]))
                if take:
                    runs.append((length, take))
                    left[length] -= take
                    need -= take
            slots.append(runs)
        marks = sorted({0, *(int(x) for runs in slots for x in np.cumsum([n for _, n in runs]))})
        for low, high in zip(marks, marks[1:]):
            lengths = []
            for runs in slots:
                ends = np.cumsum([n for _, n in runs])
                lengths.append(runs[int(np.searchsorted(ends, low, "right"))][0])
            layout = tuple((n, len(list(same))) for n, same in groupby(sorted(lengths, reverse=True)))
            bins.setdefault(capacity - sum(lengths), []).append((layout, high - low))
    for length in range(capacity, 0, -1):
        count = int(left[length])
        space = length
        while count:
            while space <= capacity and not bins.get(space):
                space += 1
            if space > capacity:
                bins.setdefault(capacity, []).append(((), -(-count // (capacity // length))))
                space = capacity
            layout, number = bins[space].pop()
            copies = space // length
            taken = min(number, count // copies)
            if not taken:
                taken, copies = 1, count
            if number > taken:
                bins[space].append((layout, number - taken))
            bins.setdefault(space - copies * length, []).append(((*layout, (length, copies)), taken))
            count -= taken * copies
    first, sequence, offset, copies_, lengths, base = [], [], [], [], [], 0
    for space in sorted(bins):
        for layout, number in bins[space]:
            at = 0
            for length, copies in layout:
                first.append(int(firsts[length] + used[length]))
                used[length] += copies * number
                sequence.append(base)
                offset.append(at)
                copies_.append(copies)
                lengths.append(length)
                at += copies * length
            base += number
    order = np.argsort(np.array(first, np.int64), kind="stable")
    pick = lambda values: np.array(values, np.int64)[order]
    return {"first": pick(first), "sequence": pick(sequence), "offset": pick(offset), "copies": pick(copies_), "length": pick(lengths)}


def pack(
    docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, classes: int = CLASSES
) -> DataFrame:
    """The pieces of :func:`token_pieces` with ``sequence_id`` and ``offset``.

    Every piece is placed once; a sequence holds at most ``capacity`` tokens and has no
    gaps. An empty table gives an empty result; ties in length are broken by id and piece.
    """
    pieces = stage(token_pieces(docs, tokenizer_path, doc_id, text, capacity), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[length] = n
    plan = pieces.sparkSession.sparkContext.broadcast(packing_plan(counts, capacity, classes))
    numbered = number_rows(pieces, ["length", "doc_id", "piece", "ids_crc32"], "number")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = plan.value
        for batch in batches:
            number = batch.column("number").to_numpy() - 1
            run = np.searchsorted(runs["first"], number, "right") - 1
            rank = number - runs["first"][run]
            copies = runs["copies"][run]
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            placed = [runs["sequence"][run] + rank // copies, runs["offset"][run] + rank % copies * runs["length"][run]]
            yield pa.RecordBatch.from_arrays(
                [*kept, *(pa.array(x, pa.int64()) for x in placed)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return numbered.mapInArrow(
        place, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    )
