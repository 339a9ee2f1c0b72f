"""Language-model scoring: interpolated modified Kneser-Ney over word pairs.

Spark counts, in three passes that keep no text: words, then pairs of neighbours, then per
word its follower statistics and the number of words it follows. A pass tallies inside its
task, ships sorted blocks of keys to the shard that owns them, and the shard's task writes
them as a sorted array of hashes (or of pair numbers) into the shared folder. Workers map
these files into memory and look up the sorted distinct keys of a slice of texts at once,
so a worker holds the pages it touches and not the model.

A word's number is its place among the sorted hashes of all shards; a pair is two numbers
in one key. Pairs are dealt to shards by a mixed key, so a word with any number of
followers is spread over all of them.

With c the count of a pair, D1, D2, D3+ the discounts taken from the counts of counts
(Chen and Goodman), N1, N2, N3+ the followers of v by count, and t(w) the number of
different words before w::

    p(w | v) = (c(vw) - D(c)) / c(v) + (D1 N1(v) + D2 N2(v) + D3+ N3+(v)) / c(v) * p(w)
    p(w)     = (t(w) - D(t)) / pairs + (D1 T1 + D2 T2 + D3+ T3+) / pairs / (V + 1)

Both add up to 1 over the V words seen and one unseen word.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.llm.common import slices, texts_of
from plumbline.llm.decontamination import Words
from plumbline.plans.cutting import scratch_path, stage, staging

#: Every so many-th id is never learned from, by the remainder of its checksum.
HELD_OUT_OF, HELD_OUT = 7, 2
#: Distinct keys that a task tallies before it ships them.
TALLY = 1 << 22
#: Words whose statistics lie in one file.
CHUNK_BITS = 17
#: A-Z to a-z and white space to spaces; all else stays.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
#: The hash that stands for the end of a text.
END = np.uint64(0xE4D0F7E875A5E5D1)

_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from; a row without an id is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_OF == HELD_OUT, F.lit(False))


# ---- sorted arrays, their blocks on the way, and their files ----


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _packed(values: np.ndarray) -> bytes:
    """Byte by byte of all values, so that leading zeros of small ones lie together and compress."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpacked(block: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(block, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each key, by its leading bits; ascending keys have ascending shards."""
    return (((keys >> _32) * np.uint64(shards)) >> _32).astype(np.int64)


def _mixed(keys: np.ndarray) -> np.ndarray:
    keys = (keys ^ (keys >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (keys ^ (keys >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)


def _pair_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return _shard(_mixed(keys), shards)


class Tally:
    """Counts of keys within one task, handed on in sorted blocks by shard."""

    schema = "shard int, keys binary, counts binary"

    def __init__(self, shards: int, shard_of) -> None:
        self.shards, self.shard_of = shards, shard_of
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        self.parts.append(_merged(keys, np.ones(len(keys), np.uint64) if counts is None else counts))
        self.size += len(self.parts[-1][0])
        if self.size > TALLY:
            self._merge()
            if self.size > TALLY // 2:
                yield from self.blocks()

    def _merge(self) -> None:
        keys, counts = zip(*self.parts)
        self.parts = [_merged(np.concatenate(keys), np.concatenate(counts))]
        self.size = len(self.parts[0][0])

    def blocks(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        self._merge()
        keys, counts = self.parts[0]
        shard = self.shard_of(keys, self.shards)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            own = order[cuts[s] : cuts[s + 1]]
            blocks = [pa.array([_packed(x)], pa.binary()) for x in (np.diff(keys[own], prepend=np.uint64(0)), counts[own])]
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), *blocks], ["shard", "keys", "counts"])
        self.parts, self.size = [], 0


def _gathered(batches: Iterator[pa.RecordBatch]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The merged keys and counts of each shard that came to this task."""
    held: dict[int, list] = {}
    sizes: dict[int, int] = {}
    for batch in batches:
        for shard, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("shard", "keys", "counts"))):
            held.setdefault(shard, []).append((np.cumsum(_unpacked(keys), dtype=np.uint64), _unpacked(counts)))
            sizes[shard] = sizes.get(shard, 0) + len(held[shard][-1][0])
            if sizes[shard] > 2 * TALLY and len(held[shard]) > 1:
                held[shard] = [_merged(*(np.concatenate(x) for x in zip(*held[shard])))]
                sizes[shard] = len(held[shard][0][0]) // 2  # merged again once as much has come
    return {shard: _merged(*(np.concatenate(x) for x in zip(*parts))) for shard, parts in held.items()}


def _mounted(path: str) -> str:
    """``path`` as the workers open it."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"the model is mapped into memory, so spark.checkpoint.dir must be a mounted folder, not {path}")
    return parts.path


def _save(folder: str, name: str, array: np.ndarray) -> None:
    """Write a file of the model; a retried task replaces it by the same content."""
    os.makedirs(folder, exist_ok=True)
    part = f"{folder}/{name}.{os.getpid()}.part"
    with open(part, "wb") as out:
        np.save(out, array)
    os.replace(part, f"{folder}/{name}.npy")


def _narrow(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.min_scalar_type(int(counts.max()))) if len(counts) else counts


# ---- the model ----


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Of counts 1, 2 and more; half the count where the counts of counts give none between 0 and the count."""
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
    found = (1 - 2 * y * n2 / n1 if n1 else 0.0, 2 - 3 * y * n3 / n2 if n2 else 0.0, 3 - 4 * y * n4 / n3 if n3 else 0.0)
    return tuple(d if 0 < d <= k else k / 2 for k, d in enumerate(found, 1))  # type: ignore[return-value]


@dataclass
class Model:
    """What a worker needs to find the arrays, and the figures of the whole corpus."""

    folder: str
    shards: int
    offsets: np.ndarray  # number of the first word of each shard, and V at the end
    tokens: int = 0
    texts: int = 0
    pairs: int = 0
    pair_discounts: tuple[float, float, float] = (0.5, 1.0, 1.5)
    word_discounts: tuple[float, float, float] = (0.5, 1.0, 1.5)
    unseen: float = 1.0  # weight of the uniform distribution

    @property
    def words(self) -> int:
        return int(self.offsets[-1])


class Arrays:
    """The mapped files of a model, opened where they are first needed."""

    def __init__(self, model: Model) -> None:
        self.model, self.open = model, {}

    def file(self, name: str) -> np.ndarray | None:
        if name not in self.open:
            path = f"{self.model.folder}/{name}.npy"
            self.open[name] = np.load(path, mmap_mode="r") if os.path.exists(path) else None
        return self.open[name]

    def _find(self, table: str, keys: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in its shard (-1 if missing) and count of each of the ascending ``keys``."""
        place, count = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(self.model.shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            own = order[cuts[s] : cuts[s + 1]]
            known = self.file(f"{table}-keys-{s}")
            if known is None or not len(known):
                continue
            at = np.minimum(np.searchsorted(known, keys[own]), len(known) - 1)
            same = known[at] == keys[own]
            place[own[same]] = at[same]
            count[own[same]] = self.file(f"{table}-counts-{s}")[at[same]]
        return place, count

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (-1 if unseen) and count of the ascending ``hashes``."""
        shard = _shard(hashes, self.model.shards)
        place, count = self._find("words", hashes, shard)
        return np.where(place >= 0, place + self.model.offsets[shard], -1), count

    def pairs(self, keys: np.ndarray) -> np.ndarray:
        """Counts of the ascending pair keys."""
        return self._find("pairs", keys, _pair_shard(keys, self.model.shards))[1]

    def statistics(self, numbers: np.ndarray) -> np.ndarray:
        """N1, N2, N3+ and the number of words before, for each word number; zeros for -1."""
        out = np.zeros((4, len(numbers)), np.int64)
        chunk = np.where(numbers >= 0, numbers >> CHUNK_BITS, -1)
        order = np.argsort(chunk, kind="stable")
        distinct, first = np.unique(chunk[order], return_index=True)
        for c, own in zip(distinct.tolist(), np.split(order, first[1:])):
            table = self.file(f"statistics-{c}") if c >= 0 else None
            if table is not None:
                out[:, own] = table[:, numbers[own] & ((1 << CHUNK_BITS) - 1)]
        return out


def _sequence(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all texts in a row, an end after each, and where each text begins and ends."""
    n = words.stops - words.firsts
    k = np.arange(len(n))
    tokens = np.full(len(words.hashes) + len(n), END, np.uint64)
    tokens[np.arange(len(words.hashes)) + np.repeat(k, n)] = words.hashes
    return tokens, words.firsts + k, words.stops + k


def _numbered(tokens: np.ndarray, firsts: np.ndarray, arrays: Arrays):
    """Distinct hashes with number and count, each token's place among them, and of its predecessor (-1: a beginning)."""
    distinct, place = np.unique(tokens, return_inverse=True)
    numbers, counts = arrays.words(distinct)
    before = np.concatenate([[-1], place[:-1]]) if len(place) else place
    before[firsts] = -1
    return numbers, counts, place, before


def train(docs: DataFrame, text: str = "text", shards: int | None = None) -> Model:
    """Count the texts of ``docs`` into arrays below the shared folder (owned by the current staging scope)."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = _mounted(scratch_path(spark, "language-model"))
    texts = docs.select(F.col(text).alias("text"))
    made = _count_words(texts, folder, shards)
    sizes = np.zeros(shards, np.int64)
    for row in made:
        sizes[row["shard"]] = row["words"]
    model = Model(folder, shards, np.concatenate([[0], np.cumsum(sizes)]), sum(r["tokens"] for r in made), sum(r["texts"] for r in made))
    if model.words >= 1 << 32:
        raise ValueError("pair keys hold word numbers of 32 bits")
    if model.words:
        _count_pairs(texts, model)
    return model


def _count_words(texts: DataFrame, folder: str, shards: int) -> list:
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Tally(shards, _shard)
        for batch in slices(batches, "text"):
            tokens, _, _ = _sequence(Words(texts_of(batch, "text"), FOLD))
            yield from held.add(tokens)
        yield from held.blocks()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for shard, (keys, counts) in _gathered(batches).items():
            _save(folder, f"words-keys-{shard}", keys)
            _save(folder, f"words-counts-{shard}", _narrow(counts))
            rows.append({"shard": shard, "words": len(keys), "tokens": int(counts.sum()), "texts": int(counts[keys == END].sum())})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("shard", pa.int32()), *[(c, pa.int64()) for c in ("words", "tokens", "texts")]]))

    blocks = texts.mapInArrow(tally, Tally.schema).repartitionById(shards, F.col("shard"))
    return blocks.mapInArrow(write, "shard int, words bigint, tokens bigint, texts bigint").collect()  # a row a shard


def _count_pairs(texts: DataFrame, model: Model) -> None:
    """Write the pairs and the statistics of words, and complete ``model``."""
    chunks = (model.words >> CHUNK_BITS) + 1  # the beginning has the number after the last word

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, arrays = Tally(model.shards, _pair_shard), Arrays(model)
        for batch in slices(batches, "text"):
            tokens, firsts, _ = _sequence(Words(texts_of(batch, "text"), FOLD))
            numbers, _, place, before = _numbered(tokens, firsts, arrays)
            left = np.where(before >= 0, numbers[before], model.words)
            yield from held.add(left.astype(np.uint64) << _32 | numbers[place].astype(np.uint64))
        yield from held.blocks()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, (keys, counts) in _gathered(batches).items():
            _save(model.folder, f"pairs-keys-{shard}", keys)
            _save(model.folder, f"pairs-counts-{shard}", _narrow(counts))
            yield from _statistics(keys, counts)

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        rows = []
        for batch in batches:
            for chunk, *blocks in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if chunk < 0:
                    rows.append(["pairs", *np.frombuffer(blocks[0], np.int64).tolist()])
                    continue
                table = tables.setdefault(chunk, np.zeros((4, 1 << CHUNK_BITS), np.int64))
                at = np.cumsum(_unpacked(blocks[0]), dtype=np.uint64).astype(np.int64)
                for k in range(4):
                    table[k, at] += _unpacked(blocks[k + 1]).astype(np.int64)
        for chunk, table in tables.items():
            _save(model.folder, f"statistics-{chunk}", table)
            rows.append(["words", *(int((table[3] == k).sum()) for k in (1, 2, 3, 4)), int((table[3] >= 3).sum()), int(table[3].sum())])
        if rows:
            kinds = [pa.string(), *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], ["kind", *(f"n{k}" for k in range(1, 7))])

    blocks = texts.mapInArrow(tally, Tally.schema).repartitionById(model.shards, F.col("shard"))
    found = blocks.mapInArrow(write, "chunk int, at binary, n1 binary, n2 binary, n3 binary, before binary")
    # rows of no chunk hold a shard's counts of counts and go anywhere
    target = F.when(F.col("chunk") < 0, F.lit(0)).otherwise(F.col("chunk"))
    made = found.repartitionById(chunks, target).mapInArrow(dense, "kind string, " + ", ".join(f"n{k} bigint" for k in range(1, 7)))
    sums = {kind: np.zeros(6, np.int64) for kind in ("pairs", "words")}
    for kind, *counts in made.collect():  # a row a shard and a row a chunk
        sums[kind] += np.array(counts)
    model.pair_discounts = _discounts(*sums["pairs"][:4].tolist())
    model.word_discounts = _discounts(*sums["words"][:4].tolist())
    n1, n2, _, _, more, model.pairs = sums["words"].tolist()
    d1, d2, d3 = model.word_discounts
    model.unseen = (d1 * n1 + d2 * n2 + d3 * more) / model.pairs


def _statistics(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per word of a shard's pairs: followers by count, and words before; then the counts of counts."""
    left, right = (keys >> _32).astype(np.int64), (keys & _LOW).astype(np.int64)
    ids, place = np.unique(np.concatenate([left, right]), return_inverse=True)
    left, right = place[: len(left)], place[len(left) :]
    tables = [np.bincount(left[counts == 1], minlength=len(ids)), np.bincount(left[counts == 2], minlength=len(ids))]
    tables += [np.bincount(left[counts > 2], minlength=len(ids)), np.bincount(right, minlength=len(ids))]
    names = ["chunk", "at", "n1", "n2", "n3", "before"]
    distinct, first = np.unique(ids >> CHUNK_BITS, return_index=True)
    for chunk, start, stop in zip(distinct.tolist(), first, [*first[1:], len(ids)]):
        at = (ids[start:stop] & ((1 << CHUNK_BITS) - 1)).astype(np.uint64)
        parts = [_packed(np.diff(at, prepend=np.uint64(0))), *(_packed(t[start:stop]) for t in tables)]
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), *(pa.array([p], pa.binary()) for p in parts)], names)
    whole = np.array([*(int((counts == k).sum()) for k in (1, 2, 3, 4)), int((counts > 2).sum()), len(keys)], np.int64)
    row = [pa.array([whole.tobytes()], pa.binary()), *[pa.array([b""], pa.binary())] * 4]
    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), *row], names)


# ---- scoring ----


def _discounted(counts: np.ndarray, discounts: tuple[float, float, float]) -> np.ndarray:
    return counts - np.array([0.0, *discounts])[np.minimum(counts, 3)]


def token_probabilities(tokens: np.ndarray, firsts: np.ndarray, model: Model, arrays: Arrays) -> tuple[np.ndarray, np.ndarray]:
    """Probability and training count of each token of a sequence as :func:`_sequence` makes it."""
    numbers, counts, place, before = _numbered(tokens, firsts, arrays)
    n1, n2, n3, heads = arrays.statistics(np.concatenate([numbers, [model.words if model.words else -1]]))
    alone = _discounted(heads[:-1], model.word_discounts) / max(model.pairs, 1) + model.unseen / (model.words + 1)
    seen = np.concatenate([counts, [model.texts]])  # the beginning comes last, as place -1 finds it
    d1, d2, d3 = model.pair_discounts
    rest = (d1 * n1 + d2 * n2 + d3 * n3) / np.maximum(seen, 1)
    known = (numbers[place] >= 0) & (seen[before] > 0)
    left = np.where(before >= 0, numbers[before], model.words)[known].astype(np.uint64)
    keys, at = np.unique(left << _32 | numbers[place][known].astype(np.uint64), return_inverse=True)
    together = np.zeros(len(tokens), np.int64)
    together[known] = arrays.pairs(keys)[at]
    follows = _discounted(together, model.pair_discounts) / np.maximum(seen[before], 1)
    return np.where(seen[before] > 0, follows + rest[before] * alone[place], alone[place]), counts[place]


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep`` of every row, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, ``perplexity``.

    Scores are log10 probabilities of the whole text and its end: of the model, and of
    single words with one added to each count. A null text is an empty one, whose only
    token is its end. Rows that repeat are scored each; an empty table gives an empty one;
    other columns, whatever their names, are left aside.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = Arrays(model)
        for batch in slices(batches, "text"):
            tokens, firsts, ends = _sequence(Words(texts_of(batch, "text"), FOLD))
            chance, counts = token_probabilities(tokens, firsts, model, arrays)
            n = ends - firsts + 1
            total = np.add.reduceat(np.log10(chance), firsts)
            base = np.add.reduceat(np.log10((counts + 1) / (model.tokens + model.words + 1)), firsts)
            figures = [n, np.add.reduceat((counts > 0).astype(np.int64), firsts), np.full(len(n), model.tokens), base, total, 10.0 ** (-total / n)]
            yield pa.RecordBatch.from_arrays([*[batch.column(f"keep{i}") for i in range(len(keep))], *map(pa.array, figures)], [*keep, *names])

    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    kinds = ["bigint"] * 3 + ["double"] * 3
    head = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    narrow = docs.select(*[F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)], F.col(text).alias("text"))
    return narrow.mapInArrow(measure, ", ".join([*head, *map(" ".join, zip(names, kinds))]))


def score_all(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int | None = None) -> DataFrame:
    """``doc_id``, ``held_out`` and the figures of :func:`score`, learned from the rows that are not held out.

    A null id is never held out. Without any row to learn from, every token counts as the
    one unseen word, which then has probability 1.
    """
    spark: SparkSession = docs.sparkSession
    with staging(spark):
        model = train(docs.where(~held_out(F.col(doc_id))), text, shards)
        marked = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
        return stage(score(marked, model, ("doc_id", "held_out")), "scores", outer=True)


def oracle(places: int = 6) -> str:
    """The same over ``documents`` in DuckDB, without perplexity, scores rounded."""
    count = lambda k: f"count(*) FILTER (c = {k})"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(crc % {HELD_OUT_OF} = {HELD_OUT}, false) AS held_out, words
    FROM (SELECT doc_id, {_crc_sql("doc_id")} AS crc,
      list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), ' ') AS words FROM documents)),
t AS (SELECT rid, doc_id, held_out, words[i] AS w, CASE WHEN i = 1 THEN '' ELSE words[i - 1] END AS v
    FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM d)),
u AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
p AS (SELECT v, w, count(*) AS c FROM t WHERE NOT held_out GROUP BY v, w),
x AS (SELECT v, sum(c) AS cv, {count(1)} AS n1, {count(2)} AS n2, count(*) FILTER (c > 2) AS n3 FROM p GROUP BY v),
h AS (SELECT w, count(*) AS c FROM p GROUP BY w),
{_discount_sql("dp", "p")},
{_discount_sql("dh", "h")},
n AS (SELECT coalesce((SELECT sum(c) FROM u), 0)::BIGINT AS tokens, (SELECT count(*) FROM u) AS v, (SELECT count(*) FROM p) AS pairs),
g AS (SELECT CASE WHEN pairs = 0 THEN 1.0 ELSE (SELECT d1 * {count(1)} + d2 * {count(2)} + d3 * count(*) FILTER (c > 2) FROM h, dh GROUP BY d1, d2, d3) / pairs END AS unseen FROM n),
s AS (SELECT t.*, coalesce(u.c, 0) AS c, coalesce(x.cv, 0) AS cv, coalesce(p.c, 0) AS cp, n.tokens, n.v AS size,
    (coalesce(h.c, 0) - CASE WHEN h.c IS NULL THEN 0 WHEN h.c = 1 THEN dh.d1 WHEN h.c = 2 THEN dh.d2 ELSE dh.d3 END) / greatest(pairs, 1) + unseen / (n.v + 1) AS p1,
    (dp.d1 * x.n1 + dp.d2 * x.n2 + dp.d3 * x.n3) AS rest,
    coalesce(p.c, 0) - CASE WHEN p.c IS NULL THEN 0 WHEN p.c = 1 THEN dp.d1 WHEN p.c = 2 THEN dp.d2 ELSE dp.d3 END AS own
    FROM t LEFT JOIN u ON t.w = u.w LEFT JOIN x ON t.v = x.v LEFT JOIN p ON t.v = p.v AND t.w = p.w LEFT JOIN h ON t.w = h.w, n, g, dp, dh)
SELECT doc_id, held_out, count(*)::BIGINT AS n_tokens, count(*) FILTER (c > 0)::BIGINT AS n_known, any_value(tokens)::BIGINT AS train_tokens,
    round(sum(log10((c + 1) / (tokens + size + 1))), {places}) AS base_score,
    round(sum(log10(CASE WHEN cv = 0 THEN p1 ELSE own / cv + rest / cv * p1 END)), {places}) AS score
FROM s GROUP BY rid, doc_id, held_out"""


def _crc_sql(column: str) -> str:
    """The checksum of a number's decimal digits: a step per byte, then eight per bit."""
    steps = f"flatten(list_transform(string_split({column}::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    bit = "CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda a, b: {bit}), 4294967295::BIGINT)"


def _discount_sql(name: str, table: str) -> str:
    """A row d1, d2, d3 from the counts ``c`` of ``table``."""
    n = [f"(count(*) FILTER (c = {k}))::DOUBLE AS n{k}" for k in (1, 2, 3, 4)]
    pick = ", ".join(f"CASE WHEN e{k} > 0 AND e{k} <= {k} THEN e{k} ELSE {k / 2} END AS d{k}" for k in (1, 2, 3))
    return f"""{name} AS (SELECT {pick} FROM (SELECT
    CASE WHEN n1 > 0 THEN 1 - 2 * y * n2 / n1 ELSE 0 END AS e1, CASE WHEN n2 > 0 THEN 2 - 3 * y * n3 / n2 ELSE 0 END AS e2,
    CASE WHEN n3 > 0 THEN 3 - 4 * y * n4 / n3 ELSE 0 END AS e3
    FROM (SELECT *, CASE WHEN n1 + n2 > 0 THEN n1 / (n1 + 2 * n2) ELSE 0 END AS y FROM (SELECT {", ".join(n)} FROM {table}))))"""
