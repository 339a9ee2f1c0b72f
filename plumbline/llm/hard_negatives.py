"""Hard negatives by inner product: length buckets with sorted coordinate lists.

After Teflioudi, Gemulla and Mykytiuk, "LEMP: Fast Retrieval of Large Entries in a Matrix
Product" (SIGMOD 2015). A task sorts its rows by label and length and cuts them into
buckets of similar length. What an anchor must reach, divided by its length and the
bucket's greatest, bounds the cosine of whatever may still count; a bucket whose bound is
above 1 is skipped with all shorter ones. In the others, the anchor's largest coordinates
have feasible ranges, which are found in the bucket's sorted lists and intersected. Only
what is left is verified, with exact whole numbers.

Anchors are broadcast in blocks of ``BLOCK_VALUES`` components, and every block meets all
rows: once for its positives, once for negatives in the range that each positive sets. A
first look at one row in ``SEED`` gives scores that are reached anyway, so in the
pass over all rows a task reports little that another one beats. It changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.plans.cutting import scratch_path, stage, staging

POSITIVES, NEGATIVES = 5, 3
#: Negatives score from 50 to 95 hundredths of their positive.
LEAST_PERCENT, MOST_PERCENT = 50, 95
#: Components of the anchors in one broadcast, and of the rows that a task looks at together.
BLOCK_VALUES, CHUNK_VALUES = 1 << 22, 1 << 22
#: One row in so many is looked at first.
SEED = 16
#: Coordinates whose ranges are intersected, rows a bucket has at least, and its shortest length by its greatest.
FOCUS, BUCKET, SPREAD = 4, 64, 0.9
_SLACK = 1e-9


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of each component; null if any is null or not finite."""
    unfit = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(~F.exists(vector, unfit), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint")))


class Bucket:
    """Rows of one label, dimension and about one length."""

    def __init__(self, label: int, ids: np.ndarray, vectors: np.ndarray, lengths: np.ndarray):
        self.label, self.ids, self.vectors, self.longest = label, ids, vectors, float(lengths[0])
        self.directions = vectors / np.maximum(lengths, 1e-300)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows in the order of coordinate ``f``, and its values."""
        if f not in self.lists:
            order = np.argsort(self.directions[:, f])
            self.lists[f] = order, self.directions[order, f]
        return self.lists[f]

    def candidates(self, direction: np.ndarray, focus: np.ndarray, cosine: float) -> np.ndarray | slice:
        """Rows whose focus coordinates allow an angle of at least that cosine with ``direction``."""
        if cosine <= 0:
            return slice(None)
        x = direction[focus]
        reach = np.sqrt(np.maximum((1 - x * x) * (1 - cosine * cosine), 0))
        low = np.where(x >= -cosine, x * cosine - reach, -1.0) - _SLACK
        high = np.where(x <= cosine, x * cosine + reach, 1.0) + _SLACK
        found = []
        for f, a, b in zip(focus.tolist(), low, high):
            values = self.sorted_list(f)[1]
            found.append((np.searchsorted(values, a), np.searchsorted(values, b, "right")))
        best = min(range(len(found)), key=lambda i: found[i][1] - found[i][0])
        rows = self.sorted_list(int(focus[best]))[0][found[best][0] : found[best][1]]
        for i, f in enumerate(focus.tolist()):
            if i != best and len(rows):
                value = self.directions[rows, f]
                rows = rows[(value >= low[i]) & (value <= high[i])]
        return rows


def _buckets(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> dict[int, list[Bucket]]:
    """The buckets of each label, longest first."""
    lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
    order = np.lexsort((-lengths, labels))
    ids, labels, vectors, lengths = ids[order], labels[order], vectors[order], lengths[order]
    out: dict[int, list[Bucket]] = {}
    start = 0
    while start < len(ids):
        end = int(np.searchsorted(labels, labels[start], "right"))
        shorter = start + int(np.searchsorted(-lengths[start:end], -SPREAD * lengths[start], "right"))
        stop = min(max(shorter, start + BUCKET), end)
        label = int(labels[start])
        out.setdefault(label, []).append(Bucket(label, ids[start:stop], vectors[start:stop], lengths[start:stop]))
        start = stop
    return out


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Length of each list and all their values in a row."""
    return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)


def _checked(vectors: np.ndarray, other: np.ndarray) -> np.ndarray:
    """``vectors`` as numbers in which inner products with ``other`` are exact."""
    if not vectors.size or not other.size:
        return vectors.astype(np.float64)
    bound = vectors.shape[1] * float(np.abs(vectors.astype(np.float64)).max()) * float(np.abs(other.astype(np.float64)).max())
    if bound >= 2.0**62:
        raise ValueError("inner products would not fit a long")
    return vectors.astype(np.float64) if bound < 2.0**52 else vectors


@dataclass
class Block:
    """Anchors, and what is known of them: ``want`` rows in the score ranges ``low`` to ``high`` of each slot."""

    ids: np.ndarray
    labels: np.ndarray
    sizes: np.ndarray
    values: np.ndarray
    want: int
    same_label: bool
    low: np.ndarray  # anchors x slots; a slot is one list of results
    high: np.ndarray

    def by_dimension(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        starts = np.cumsum(self.sizes) - self.sizes
        for d in np.unique(self.sizes).tolist():
            own = np.flatnonzero(self.sizes == d)
            yield d, own, self.values[starts[own][:, None] + np.arange(d)]


class Search:
    """The best rows of every slot among those that one task has seen."""

    def __init__(self, block: Block):
        self.block = block
        self.bounds = block.low.copy()  # what a row must score to count, per anchor and slot
        self.held: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.parts = list(block.by_dimension())

    def look(self, ids: np.ndarray, labels: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> None:
        starts = np.cumsum(sizes) - sizes
        for d, own, anchors in self.parts:
            rows = np.flatnonzero(sizes == d)
            if not len(rows):
                continue
            vectors = values[starts[rows][:, None] + np.arange(d)]
            exact = _checked(vectors, anchors)
            buckets = _buckets(ids[rows], labels[rows], exact)
            anchors = anchors.astype(exact.dtype)
            lengths = np.sqrt((anchors.astype(np.float64) ** 2).sum(1))
            directions = anchors / np.maximum(lengths, 1e-300)[:, None]
            focus = np.argsort(-np.abs(directions), axis=1, kind="stable")[:, :FOCUS]
            for k, a in enumerate(own.tolist()):
                label = int(self.block.labels[a])
                chosen = [buckets.get(label, [])] if self.block.same_label else [b for name, b in buckets.items() if name != label]
                for group in chosen:
                    self._meet(a, group, anchors[k], directions[k], focus[k], lengths[k])

    def _meet(self, a: int, group: list[Bucket], vector, direction, focus, length: float) -> None:
        open_slots = self.block.high[a] >= self.block.low[a]
        if not open_slots.any():
            return
        for bucket in group:
            reach = length * bucket.longest
            least = float(self.bounds[a][open_slots].min())
            if reach == 0:
                if least > 0:
                    return
                rows = slice(None)
            else:
                cosine = least / reach - _SLACK
                if cosine > 1:
                    return  # so it is for all shorter rows
                rows = bucket.candidates(direction, focus, cosine)
            ids = bucket.ids[rows]
            if not len(ids):
                continue
            scores = bucket.vectors[rows] @ vector
            near = (scores >= least) & (ids != self.block.ids[a])
            if near.any():
                self._keep(a, open_slots, ids[near], scores[near])

    def _keep(self, a: int, open_slots: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        for j in np.flatnonzero(open_slots).tolist():
            fits = (scores >= self.bounds[a, j]) & (scores <= self.block.high[a, j])
            if not fits.any():
                continue
            own, best = ids[fits], scores[fits]
            if len(own) > self.block.want:
                top = np.lexsort((own, -best))[: self.block.want]
                own, best = own[top], best[top]
            pairs = self.held.get((a, j), []) + list(zip((-best.astype(np.int64)).tolist(), own.tolist()))
            self.held[a, j] = pairs = sorted(pairs)[: self.block.want]
            if len(pairs) == self.block.want:
                self.bounds[a, j] = max(self.bounds[a, j], -pairs[-1][0])


_FOUND = "anchor int, slot int, id bigint, score bigint"


def _found(rows: DataFrame, block: Block) -> DataFrame:
    """The ``want`` best rows of each anchor's slots: by score, then smaller id, ranked from 1."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(shared.value)
        waiting, size = [], 0

        def look_at(waiting: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(waiting).combine_chunks()
            sizes, values = _matrix(table.column("vector").chunk(0))
            search.look(table.column("id").to_numpy(), table.column("label").to_numpy(), sizes, values)

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                size += len(batch.column("vector").flatten())
            if size > CHUNK_VALUES:
                look_at(waiting)
                waiting, size = [], 0
        if waiting:
            look_at(waiting)
        out = [(a, j, row, -score) for (a, j), pairs in search.held.items() for score, row in pairs]
        if out:
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["anchor", "slot", "id", "score"])

    best = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return rows.mapInArrow(look, _FOUND).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= block.want)


def _reached(found: DataFrame, block: Block) -> np.ndarray:
    """Score of the last wanted row of each slot that has so many, else the slot's low end."""
    out = block.low.copy()
    last = found.where(F.col("rank") == block.want).select("anchor", "slot", "score").toArrow()  # at most a row a slot
    at = last.column("anchor").to_numpy(), last.column("slot").to_numpy()
    out[at] = np.maximum(out[at], last.column("score").to_numpy())
    return out


def _blocks(anchors: DataFrame, limit: int) -> Iterator[pa.Table]:
    """The anchors in tables of about ``limit`` components."""
    total = anchors.agg(F.sum(F.size("vector") + 1)).first()[0] or 0
    blocks = -(-total // limit)
    for k in range(blocks):
        table = anchors.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).toArrow()
        if table.num_rows:
            yield table.sort_by([("id", "ascending"), ("label", "ascending")]).combine_chunks()


def _low(anchors: int, slots: int) -> np.ndarray:
    return np.full((anchors, slots), -(2**62), np.int64)


def mine(rows: DataFrame, is_anchor: Column, limit: int = BLOCK_VALUES) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``rows`` is [id, label, vector] with vectors of whole numbers. An anchor's positives are
    the 5 other rows of its label that score highest; per positive, the 3 highest rows of
    other labels that score 50 to 95 hundredths of it are returned. Ties go by smaller id;
    "other" rows have another id. ``is_anchor`` is an expression on ``id``. Rows with a null anywhere take no part, rows that repeat
    as a whole count once, and rows that share only their id are rows of their own. Vectors
    of different dimension have no score; an empty vector scores 0 with empty ones. A
    positive with a negative score has no negatives. An empty table gives an empty result.
    Scores beyond a long are an error.
    """
    spark = rows.sparkSession
    plain = rows.select(F.col("id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), "vector")
    whole = ~F.exists("vector", lambda x: x.isNull())
    with staging(spark):
        own = stage(plain.where(F.col("id").isNotNull() & F.col("label").isNotNull() & whole).distinct(), "vectors")
        seed = own.where(F.pmod(F.xxhash64("id", F.lit("seed")), F.lit(SEED)) == 0)
        place = scratch_path(spark, "negatives", outer=True)
        kind = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
        spark.createDataFrame([], kind).write.parquet(f"{place}/block=-1")
        for k, table in enumerate(_blocks(own.where(is_anchor), limit)):
            sizes, values = _matrix(table.column("vector").chunk(0))
            facts = (table.column("id").to_numpy(), table.column("label").to_numpy(), sizes, values)
            n = table.num_rows
            first = Block(*facts, POSITIVES, True, _low(n, 1), np.full((n, 1), 2**62, np.int64))
            first.low = _reached(_found(seed, first), first)
            positives = _found(own, first).toArrow()  # at most five an anchor
            at = positives.column("anchor").to_numpy(), positives.column("rank").to_numpy() - 1
            score = np.full((n, POSITIVES), -1, np.int64)  # below 0: no range
            ids = np.zeros((n, POSITIVES), np.int64)
            score[at], ids[at] = positives.column("score").to_numpy(), positives.column("id").to_numpy()
            low, high = -(-LEAST_PERCENT * score // 100), MOST_PERCENT * score // 100
            high[score < 0] = -(2**62)
            second = Block(*facts, NEGATIVES, False, low, high)
            second.low = _reached(_found(seed, second), second)
            _with_ids(_found(own, second), facts[0], ids, score).write.parquet(f"{place}/block={k}")
    return spark.read.option("basePath", place).schema(f"{kind}, block int").parquet(place).drop("block")


def _with_ids(found: DataFrame, anchors: np.ndarray, positives: np.ndarray, scores: np.ndarray) -> DataFrame:
    """The numbers of anchors and slots replaced by what they stand for."""
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    shared = found.sparkSession.sparkContext.broadcast((anchors, positives, scores))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, own, score = shared.value
        for batch in batches:
            a, j = batch.column("anchor").to_numpy(), batch.column("slot").to_numpy()
            arrays = [pa.array(ids[a]), pa.array(own[a, j]), batch.column("rank"), batch.column("id"), pa.array(score[a, j]), batch.column("score")]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return found.mapInArrow(name, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")


def of_embeddings(embeddings: DataFrame, limit: int = BLOCK_VALUES) -> DataFrame:
    """:func:`mine` for [vec_id, embedding, label]: components in whole 256ths, labels of every seventh id moved on."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings.select(F.col("vec_id").alias("id"), moved.alias("label"), whole_numbers(F.col("embedding")).alias("vector"))
    return mine(rows, F.col("id") % 50 == 0, limit)


def oracle() -> str:
    """The same over ``embeddings`` in DuckDB."""
    return f"""
WITH e AS (SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
      list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, r.id, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score
    FROM e a JOIN e r ON a.id % 50 = 0 AND a.id <> r.id AND len(a.v) = len(r.v)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES}),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score,
      row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank
    FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same
      AND {LEAST_PERCENT} * positive_score <= 100 * score AND 100 * score <= {MOST_PERCENT} * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}"""
