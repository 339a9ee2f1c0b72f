"""Removal of long repeated byte strings, by suffix order and longest previous factors.

Every ``LENGTH``-byte string of a text has an anchor: the place of the least hash among
its ``GRAM``-byte grams (the leftmost, if several). Equal strings have equal anchors at
equal places, and neighbouring strings mostly share one, so a text falls into stretches
of string starts with a common anchor, cut once more in the middle. All strings of a
stretch hold a common core of more than half their length; only stretches whose core
occurs elsewhere go on, named by core.

Stretches that agree in all their bytes are one, with a count. Of the different ones,
one copy of the bytes is brought together by core, and the suffixes at all string starts
are put in order to depth ``LENGTH`` by prefix doubling. In that order a run of suffixes
with common prefix of at least ``LENGTH`` is a repeated string; the previous and next
smaller text position of a suffix lie in its run if at all, so its longest previous
factor reaches ``LENGTH`` unless it comes first in the run.

A core with more than ``CROWD`` different stretches is not put in one task: its strings
are told apart by 128-bit hashes and aggregated as rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import slices, text_key, texts_of
from plumbline.plans.cutting import stage, staging

LENGTH = 400
GRAM = 32
#: Most different stretches of one core that are ordered in one task, and bytes ordered together.
CROWD, ORDER_BYTES = 4000, 2_000_000
#: Keys that are broadcast to pick texts, after counting; more are joined.
BROADCAST_ROWS = 1_000_000
#: Starts that are looked at together in a long text (places fit into 20 bits).
PART = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xD1342543DE82EF95)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_LOW = np.uint64((1 << 20) - 1)
_BYTE = np.random.default_rng(977).integers(1, 1 << 63, 256, dtype=np.uint64)


def gram_hashes(raw: np.ndarray, size: int, base: np.uint64 = _BASE) -> np.ndarray:
    """Hash of the ``size`` bytes from each place on; doubling, so a few passes."""
    if len(raw) < size:
        return np.zeros(0, np.uint64)
    out, done, power = None, 0, _BYTE[raw]
    width, factor = 1, base
    left = size
    while left:  # the binary digits of size: out covers ``done`` bytes, power covers ``width``
        if left & 1:
            out = power.copy() if out is None else out[: len(power) - done] * factor + power[done : done + len(out)] if len(power) - done > 0 else out[:0]
            done += width
        left >>= 1
        if left:
            power = power[: len(power) - width] * factor + power[width:]
            with np.errstate(over="ignore"):
                width, factor = 2 * width, factor * factor
    out = out[: len(raw) - size + 1]
    return (out ^ (out >> np.uint64(29))) * _MIX


def anchors(grams: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For each string start the place of its least gram hash."""
    width = length - gram + 1
    n = len(grams) - width + 1
    tagged = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    padded = np.full(-(-len(grams) // width) * width, np.iinfo(np.uint64).max)
    padded[: len(grams)] = tagged
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).reshape(-1)
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return (np.minimum(back[:n], ahead[width - 1 : width - 1 + n]) & _LOW).astype(np.int64)


def stretches(text: bytes, length: int, gram: int) -> Iterator[tuple[int, bytes, int, int]]:
    """(core, name of all bytes, first start, last start) of each stretch of string starts."""
    whole = np.frombuffer(text, np.uint8)
    reach = (length - gram) // 2
    for base in range(0, len(whole) - length + 1, PART):
        raw = whole[base : base + PART + length - 1]
        grams = gram_hashes(raw, gram)
        cores = gram_hashes(raw, gram + reach, _OTHER)
        place = anchors(grams, length, gram)
        bounds = np.flatnonzero(np.diff(place)) + 1
        lows = np.concatenate([[0], bounds])
        highs = np.concatenate([bounds - 1, [len(place) - 1]])
        for low, high, at in zip(lows.tolist(), highs.tolist(), place[lows].tolist()):
            # strings that begin at least ``reach`` before the anchor hold what stands before it, the others what follows
            for first, last, core in ((low, min(high, at - reach), at - reach), (max(low, at - reach + 1), high, at)):
                if first <= last:
                    side = core != at
                    name = hashlib.blake2b(raw[first : last + length], digest_size=16, salt=(at - first).to_bytes(4, "little") + bytes([side])).digest()
                    yield int(cores[core].astype(np.int64)) ^ side, name, base + first, base + last


def repeated_starts(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, place in it, and run number of every string that occurs more than once.

    The suffixes at the string starts are ordered to depth ``length``: ranks of 8 bytes,
    then of twice as many, until two overlapping ranks cover it. Runs are numbered in
    suffix order; within a run the strings come in the order of the text.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    raw = np.frombuffer(b"".join(contexts) + bytes(8), np.uint8)
    n = len(raw) - 8
    rank = np.zeros(n, np.uint64)
    for k in range(8):
        rank = (rank << np.uint64(8)) | raw[k : k + n]
    rank = np.unique(rank, return_inverse=True)[1].astype(np.uint64)
    depth = 8
    while 2 * depth <= length:
        ahead = rank[np.minimum(np.arange(n) + depth, n - 1)]
        rank = np.unique((rank << np.uint64(32)) | ahead, return_inverse=True)[1].astype(np.uint64)
        depth *= 2
    counts = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), counts)
    inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    start = (np.cumsum(sizes) - sizes)[owner] + inner
    full = (rank[start] << np.uint64(32)) | rank[start + length - depth]
    order = np.argsort(full, kind="stable")
    ranked = full[order]
    # neighbours in suffix order with a common prefix of the whole length
    joined = ranked[1:] == ranked[:-1]
    inside = np.concatenate([joined, [False]]) | np.concatenate([[False], joined])
    run = np.cumsum(np.concatenate([[True], ~joined])) if len(ranked) else np.zeros(0, np.int64)
    return owner[order][inside], inner[order][inside], run[inside]


def as_runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """Consecutive numbers as (first, last)."""
    starts = np.sort(starts)
    cuts = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.concatenate([[0], cuts + 1])].tolist(), starts[np.concatenate([cuts, [len(starts) - 1]])].tolist()))


_RUNS = "array<struct<low:int,high:int>>"


def _ordered(copies: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """``core``, ``name``, ``runs``: string starts, within a stretch, that occur in another stretch too (or earlier)."""

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            owner, inner, run = repeated_starts([r[2] for r in held], length)
            if keep_first and len(run):  # all but the first of each run have a previous factor that long
                place = np.array([r[3] for r in held])[owner]
                by_place = np.lexsort((inner, place, run))
                first = np.concatenate([[True], run[by_place][1:] != run[by_place][:-1]])
                later = by_place[~first]
                owner, inner = owner[later], inner[later]
            cores, names, runs = [], [], []
            by_owner = np.argsort(owner, kind="stable")
            owner, inner = owner[by_owner], inner[by_owner]
            ends = np.flatnonzero(np.diff(owner)) + 1
            for part in np.split(np.arange(len(owner)), ends) if len(owner) else []:
                row = held[int(owner[part[0]])]
                cores.append(row[0])
                names.append(row[1])
                runs.append([{"low": a, "high": b} for a, b in as_runs(inner[part])])
            kind = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
            return pa.RecordBatch.from_arrays([pa.array(cores, pa.int64()), pa.array(names, pa.binary()), pa.array(runs, kind)], ["core", "name", "runs"])

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("core", "name", "bytes", "place")))
            for row in rows:
                if size >= ORDER_BYTES and row[0] != held[-1][0]:
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield flush()

    # of the place only its rank among the stretches of a core matters
    sorted_copies = copies.repartition("core").sortWithinPartitions("core", "first")
    ranked = sorted_copies.withColumn("place", F.monotonically_increasing_id())
    return ranked.select("core", "name", "bytes", "place").mapInArrow(order, f"core bigint, name binary, runs {_RUNS}")


def _by_hash(copies: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """The same as :func:`_ordered` for crowded cores, with a row per string."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes", 200_000):
            at, inner, one, two = [], [], [], []
            for row, raw in enumerate(batch.column("bytes").to_pylist()):
                bytes_ = np.frombuffer(raw, np.uint8)
                h = gram_hashes(bytes_, length)
                at.append(np.full(len(h), row))
                inner.append(np.arange(len(h), dtype=np.int32))
                one.append(h.astype(np.int64))
                two.append(gram_hashes(bytes_, length, _OTHER).astype(np.int64))
            taken = pa.array(np.concatenate(at))
            arrays = [batch.column(c).take(taken) for c in ("core", "name", "first")]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(np.concatenate(x)) for x in (inner, one, two))], ["core", "name", "first", "inner", "one", "two"])

    kind = copies.schema["first"].dataType.simpleString()
    rows = copies.select("core", "name", "first", "bytes").mapInArrow(
        strings, f"core bigint, name binary, first {kind}, inner int, one bigint, two bigint"
    )
    met = rows.groupBy("one", "two").agg(F.count(F.lit(1)).alias("met"), F.min(F.struct("first", "inner")).alias("least")).where("met > 1")
    found = rows.join(met, ["one", "two"])
    if keep_first:
        found = found.where(F.struct("first", "inner") != F.col("least"))
    starts = found.groupBy("core", "name").agg(F.collect_list("inner").alias("starts"))
    return starts.select("core", "name", F.transform("starts", lambda s: F.struct(s.alias("low"), s.alias("high"))).alias("runs"))


def repeated_ranges(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_first: bool = True, crowd: int = CROWD) -> DataFrame:
    """``id``, ``key``, ``ranges``: for each text of ``keyed`` (id, key, text) the bytes to remove, if any."""
    kind = keyed.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows: list[tuple] = []
            for row, text in enumerate(texts_of(batch, "text").to_pylist()):
                if len(text) * 4 >= length and len(raw := text.encode()) >= length:
                    rows += [(row, *s) for s in stretches(raw, length, gram)]
            row, core, name, low, high = zip(*rows) if rows else ((),) * 5
            taken = pa.array(row, pa.int64())
            arrays = [batch.column("id").take(taken), batch.column("key").take(taken), pa.array(core, pa.int64()), pa.array(name, pa.binary())]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["id", "key", "core", "name", "low", "high"])

    found = stage(keyed.mapInArrow(cut, f"id {kind}, key bigint, core bigint, name binary, low bigint, high bigint"), "stretches")
    shared = found.groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("a"), F.max("name").alias("b")).where("n > 1")
    # staged: two tables meet in exchanges of their own, which Spark splits where a core is hot
    shared = stage(shared.select("core", (F.col("a") < F.col("b")).alias("differ")), "cores")
    members = stage(found.join(shared, "core"), "members")
    place = F.struct("id", "key", "low", "high")
    stretch = stage(members.groupBy("core", "name", "differ").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("first")), "names")
    differing = stretch.where("differ")
    crowded = differing.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("core", F.lit(True).alias("crowded"))
    copies = _with_bytes(differing.join(crowded, "core", "left"), keyed, length)
    runs = _ordered(copies.where("crowded is null"), length, keep_first).unionByName(_by_hash(copies.where("crowded"), length, keep_first))
    verdict = stretch.join(runs, ["core", "name"], "left").where("copies > 1 or runs is not null")
    verdict = stage(verdict.select("core", "name", "copies", "first", "runs"), "verdict")
    joined = members.join(verdict, ["core", "name"])
    whole = F.col("copies") > 1
    if keep_first:
        whole = whole & (F.struct("id", "key", "low", "high") != F.col("first"))
    own = F.transform("runs", lambda r: F.struct((F.col("low") + r["low"]).alias("low"), (F.col("low") + r["high"] + length).alias("high")))
    all_of_it = F.array(F.struct(F.col("low").alias("low"), (F.col("high") + length).alias("high")))
    ranges = joined.select("id", "key", F.explode(F.when(whole, all_of_it).otherwise(own)).alias("range"))
    return ranges.groupBy("id", "key").agg(F.collect_list("range").alias("ranges"))


def _with_bytes(named: DataFrame, keyed: DataFrame, length: int) -> DataFrame:
    """Each named stretch with the bytes of its first occurrence."""
    wanted = named.groupBy("first.id", "first.key").agg(
        F.collect_list(F.struct("core", "name", "crowded", "first", F.col("first.low").alias("low"), F.col("first.high").alias("high"))).alias("wanted")
    )
    wanted = stage(wanted, "wanted")
    keys = wanted.select(F.col("key").alias("w_key"))
    small = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    picked = keyed.join(F.broadcast(keys) if small else keys, F.col("key") == F.col("w_key"), "left_semi").select("id", "key", "text")
    texts = picked.dropDuplicates(["id", "key"]).select(F.col("id").alias("t_id"), F.col("key").alias("t_key"), F.encode("text", "UTF-8").alias("raw"))
    met = texts.join(wanted, (F.col("t_key") == F.col("key")) & F.col("t_id").eqNullSafe(F.col("id")))
    rows = met.select("raw", F.explode("wanted").alias("w"))
    part = F.substring(F.col("raw"), (F.col("w.low") + 1).cast("int"), (F.col("w.high") - F.col("w.low") + length).cast("int"))
    return stage(rows.select("w.core", "w.name", "w.crowded", "w.first", part.alias("bytes")), "bytes")


def _merged(ranges: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for low, high in sorted((r["low"], r["high"]) for r in ranges or []):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def _marked(docs: DataFrame, doc_id: str, text: str, options: dict) -> DataFrame:
    keyed = docs.select(F.col(doc_id).alias("id"), text_key(F.col(doc_id), F.col(text)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    with staging(docs.sparkSession):
        found = stage(repeated_ranges(keyed, **options), "ranges", outer=True).withColumnsRenamed({"id": "r_id", "key": "r_key"})
    same = (F.col("key") == F.col("r_key")) & F.col("id").eqNullSafe(F.col("r_id"))
    return keyed.join(found, same, "left").select("id", "text", "ranges")


def removal_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` of every row.

    With ``keep_first=False`` every byte goes that a repeated string covers; otherwise
    the first occurrence (by id, then hash of id and text, then place) stays. A null text
    has no bytes. Rows that repeat as a whole are occurrences of their own and share
    their fate. Texts of any length are read whole; matches never cross texts. An empty
    table gives an empty result; other columns are left aside.
    """
    marked = _marked(docs, doc_id, text, options)
    kind = marked.schema["id"].dataType.simpleString()

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for text_, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
                raw, at, kept, spans = text_.encode(), 0, hashlib.sha256(), _merged(ranges)
                for low, high in spans:
                    kept.update(raw[at:low])
                    at = high
                kept.update(raw[at:])
                out.append((len(raw), sum(b - a for a, b in spans), len(spans), kept.hexdigest()))
            size, removed, n, digest = zip(*out)
            arrays = [batch.column("id"), *(pa.array(x, pa.int64()) for x in (size, removed, n)), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return marked.mapInArrow(report, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def dedup_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``doc_id`` and the text that is left, in the cases of :func:`removal_report`.

    A character of which a byte is removed goes as a whole.
    """
    marked = _marked(docs, doc_id, text, options)
    kind = marked.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            left = []
            for text_, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
                raw, at, parts = text_.encode(), 0, []
                for low, high in [*_merged(ranges), (len(raw), len(raw))]:
                    parts.append(raw[at:low].decode(errors="ignore"))
                    at = high
                left.append("".join(parts))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(left, pa.string())], ["doc_id", "text"])

    return marked.mapInArrow(cut, f"doc_id {kind}, text string")
