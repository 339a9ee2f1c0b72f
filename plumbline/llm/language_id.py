"""Language identification: sparse multinomial logistic regression on character n-grams.

Features are the relative frequencies of hashed n-grams of one to three letters, times
their inverse document frequency. The model is trained with the follow-the-regularised-
leader rule and an elastic-net penalty, on a bounded sample of labelled rows (see
``ROWS_PER_LANGUAGE``) whose features the executors make; a fifth of the sample sets the
temperature that turns logits into probabilities. Prediction is one pass over whole
texts with the weights broadcast (``BUCKETS`` numbers per language) and no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.common import fresh, slices, texts_of

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: About so many labelled rows of each language are learned from, chosen by hash.
ROWS_PER_LANGUAGE = 1500
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-4, 1e-4
SCALE = 30.0  # relative frequencies are small; this brings logits to a usual size
SLICE = 1_000_000
UNKNOWN = "und"
#: A document whose best language is less likely than this is rejected.
LEAST_SCORE = 0.3
_PRIMES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def grams(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the letters of each text, text by text, and their number.

    Case and everything but letters and marks are left out; words are set off by spaces.
    """
    clean = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{M}]+", " "), " ")
    letters = pc.utf8_length(clean).to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.where(letters > 0, letters + 3, 0)  # a space before and two after
    parts = [f" {t}  " for t in clean.to_pylist() if t]
    codes = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
    out = np.empty((len(codes), len(ORDERS)), np.int32)
    for order in ORDERS:
        total = np.full(len(codes), order, np.uint32)
        for k in range(order):
            total = (total ^ np.roll(codes, -k)) * _PRIMES[k]
            total ^= total >> np.uint32(15)
        out[:, order - 1] = total % np.uint32(buckets)
    return out.reshape(-1), sizes * len(ORDERS)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # language x bucket, the inverse document frequency included
    bias: np.ndarray
    temperature: float

    def logits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Logits by text and language, and which texts have letters."""
        buckets, counts = grams(texts, self.weights.shape[1])
        some = counts > 0
        out = np.tile(self.bias, (len(counts), 1)).astype(np.float64)
        if some.any():
            starts = (np.cumsum(counts) - counts)[some]
            for k in range(len(self.languages)):
                out[some, k] += np.add.reduceat(self.weights[k][buckets], starts, dtype=np.float64) / counts[some]
        return out, some

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        scaled = logits / self.temperature
        grown = np.exp(scaled - scaled.max(axis=1, keepdims=True))
        return grown / grown.sum(axis=1, keepdims=True)


def learn(rows: list[tuple[str, np.ndarray, np.ndarray]], buckets: int = BUCKETS, seed: int = 7) -> Model:
    """The model from (language, buckets, relative frequencies) of each sampled text."""
    languages = sorted({r[0] for r in rows})
    if len(languages) < 2:
        return Model(languages, np.zeros((len(languages), buckets), np.float32), np.zeros(len(languages)), 1.0)
    number = {name: k for k, name in enumerate(languages)}
    order = np.random.default_rng(seed).permutation(len(rows))
    held = max(len(rows) // 5, 1) if len(rows) >= 10 else 0
    kept, fresh_rows = order[held:], order[:held] if held else order
    df = np.bincount(np.concatenate([rows[i][1] for i in kept]), minlength=buckets)
    idf = (np.log((1 + len(kept)) / (1 + df)) + 1.0) * SCALE
    features = [(number[y], at, f * idf[at]) for y, at, f in rows]
    share = np.bincount([features[i][0] for i in kept], minlength=len(languages))
    importance = len(kept) / (len(languages) * np.maximum(share, 1))
    z, n = np.zeros((buckets + 1, len(languages))), np.zeros((buckets + 1, len(languages)))

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        w = -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zs) <= L1, 0.0, w)

    for _ in range(EPOCHS):
        for i in kept:
            y, at, x = features[i]
            at, x = np.append(at, buckets), np.append(x, 1.0)  # the last is the bias
            w = weights(at)
            logit = x @ w
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[y] -= 1.0
            g = np.outer(x, p * importance[y])
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / ALPHA * w
    final = weights(np.arange(buckets + 1))
    model = Model(languages, (final[:-1] * idf[:, None]).T.astype(np.float32), final[-1], 1.0)
    logits = np.array([features[i][2] @ final[features[i][1]] + final[-1] for i in fresh_rows])
    truth = np.array([features[i][0] for i in fresh_rows])

    def loss(log_t: float) -> float:
        scaled = logits / np.exp(log_t)
        top = scaled.max(axis=1, keepdims=True)
        return float((np.log(np.exp(scaled - top).sum(axis=1)) + top[:, 0] - scaled[np.arange(len(truth)), truth]).mean())

    low, high = -3.0, 3.0  # golden section
    for _ in range(40):
        a, b = high - 0.618 * (high - low), low + 0.618 * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    model.temperature = float(np.exp((low + high) / 2))
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: a quarter of the ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(labelled: DataFrame, text: str, lang: str, doc_id: str, rows_per_language: int = ROWS_PER_LANGUAGE, buckets: int = BUCKETS) -> Model:
    """A model from the rows of ``labelled`` that have text and language.

    All rows are counted; of a language with more than ``rows_per_language``, about so
    many are taken by a hash of id and language, so a retried task takes the same ones;
    rows that share both are taken or left together.
    """
    rows = labelled.select(
        F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")
    ).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros((0, buckets), np.float32), np.zeros(0), 1.0)
    shares = F.create_map(*[x for k, n in sorted(sizes.items()) for x in (F.lit(k), F.lit(min(1.0, rows_per_language / n)))])
    chance = F.pmod(F.xxhash64("id", F.lit("sample"), "lang"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(chance < F.element_at(shares, F.col("lang")))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            found, counts = grams(batch.column("text"), buckets)
            ends = np.cumsum(counts)
            names, ats, shares_ = [], [], []
            for name, end, count in zip(batch.column("lang").to_pylist(), ends, counts):
                if count:
                    at, n = np.unique(found[end - count : end], return_counts=True)
                    names.append(name)
                    ats.append(at.astype(np.int32).tobytes())
                    shares_.append((n / count).astype(np.float32).tobytes())
            arrays = [pa.array(names, pa.string()), pa.array(ats, pa.binary()), pa.array(shares_, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "at", "share"])

    made = sample.select("text", "lang").mapInArrow(featurise, "lang string, at binary, share binary").collect()
    examples = [(r[0], np.frombuffer(r[1], np.int32), np.frombuffer(r[2], np.float32)) for r in made]
    return learn(sorted(examples, key=lambda e: (e[0], e[1].tobytes(), e[2].tobytes())), buckets)


def predict(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the likeliest language and its probability.

    A null text, or one without a letter, is ``und`` with score 0, and so is every text
    if nothing was learned. Ties go to the language that comes first by name.
    """
    lang_pred, score = fresh(docs, *names)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        languages = np.array([*known.languages, UNKNOWN], object)
        for batch in slices(batches, text, SLICE):
            best, sure = np.full(batch.num_rows, len(known.languages)), np.zeros(batch.num_rows)
            if known.languages:
                logits, some = known.logits(texts_of(batch, text))
                p = known.probabilities(logits)
                best = np.where(some, p.argmax(axis=1), best)
                sure = np.where(some, p.max(axis=1), 0.0)
            made = [pa.array(languages[best], pa.string()), pa.array(sure, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, lang_pred, score])

    # the output's column order is that of the frame, with the two new columns last
    shape = docs.withColumns({lang_pred: F.lit("").cast("string"), score: F.lit(0.0)}).schema
    return docs.mapInArrow(scan, shape)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` of every row, learned from the others."""
    model = train(docs.where(~held_out(F.col(doc_id))), text, lang, doc_id, rows_per_language)
    narrow = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    return predict(narrow, model).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, model: Model, text: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The rows whose language is known with a probability of at least ``least``, unchanged."""
    found = predict(docs, model, text)
    lang_pred, score = found.columns[-2:]
    return found.where((F.col(lang_pred) != UNKNOWN) & (F.col(score) >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])
