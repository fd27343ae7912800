"""Toxicity by a chain of linear classifiers.

The categories are the label columns, in order: low quality, then toxicity. Each has a logistic regression on hashed
words, word beginnings and endings (toxic words come with many endings), selected by a chi-square test, and on a few
measures of style; a later model also gets the log-odds of all earlier categories. In training those come from
models that have not seen the row (out of fold); in scoring they come from the final models.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..storage import materialize, table
from . import textvec as V
from .linear import minimum
from .sampling import sample_keys

#: Labelled rows that the models are fitted on at most: those of the smallest hashes of doc_id.
FIT_ROWS = 6_000
#: Bytes of hashed features, 4 for each distinct one of a row, that come to the driver at most: rows of larger hashes
#: than those that fill it are left out of the fit.
FIT_BYTES = 64_000_000
HASH_BITS = 22
FOLDS = 3
#: A feature is selected from this chi-square value on; among 4 million noise features about 2 reach it.
CHI_SQUARE = 25.0
MAX_FEATURES = 8192
RIDGE = 0.1
BEGINNINGS = (3, 4, 5, 6, 7, 8)
ENDINGS = (4, 5, 6)
#: (row, hash) pairs that are counted or sorted out at a time: the driver needs little besides the pairs themselves.
CHUNK = 1 << 20
_MASK = np.uint64((1 << HASH_BITS) - 1)


def _features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, numbers of their words) of whole words, then of each length of beginning and ending, in bytes."""
    every = np.arange(len(starts))
    yield (V.span_hashes(data, starts, ends) & _MASK).astype(np.uint32), every
    length = ends - starts
    for salt, size in enumerate(BEGINNINGS + ENDINGS, 1):
        own = np.flatnonzero(length > size)
        a, b = (starts[own], starts[own] + size) if salt <= len(BEGINNINGS) else (ends[own] - size, ends[own])
        yield (V.mix(V.span_hashes(data, a, b) + V.U64(salt)) & _MASK).astype(np.uint32), own


def _style(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Shares of signs and digits, words for each byte, and the logarithm of the length, for each row."""
    sums = lambda held: np.diff(np.append(0, np.cumsum(held))[offsets])
    size = np.maximum(np.diff(offsets), 1)
    signs = sums(~V.IS_ALNUM[data] & ~V.IS_SPACE[data]) / size
    digits = sums((data >= 0x30) & (data <= 0x39)) / size
    return np.stack([signs, digits, np.diff(first) / size, np.log(size) / 10], axis=1)


def text_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features and their rows, style, and the number of words of each row."""
    data, offsets = V.column_bytes(texts)
    starts, ends, first = V.spans(data, offsets, V.IS_ALNUM)
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    parts = [(h, row_of[w]) for h, w in _features(V.LOWER[data], starts, ends)]
    return np.concatenate([h for h, _ in parts]), np.concatenate([r for _, r in parts]), _style(data, offsets, starts, first), np.diff(first)


@dataclass
class Model:
    """One link of the chain: weights by hashed feature, then of style and earlier log-odds, and the bias."""

    features: np.ndarray  # sorted
    weights: np.ndarray
    dense: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    bias: float

    def table(self, width: int = 1 << HASH_BITS) -> np.ndarray:
        out = np.zeros(width, np.float32)
        out[self.features] = self.weights
        return out

    def log_odds(self, sparse: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return sparse + ((dense - self.mean) / self.scale) @ self.dense + self.bias


def tally(rows: np.ndarray, hashes: np.ndarray, held: np.ndarray, width: int) -> np.ndarray:
    """How many of the rows marked in `held` have each feature."""
    out = np.zeros(width, np.int32)
    for i in range(0, len(rows), CHUNK):
        np.add.at(out, hashes[i : i + CHUNK][held[rows[i : i + CHUNK]]], 1)
    return out


def select(rows: np.ndarray, hashes: np.ndarray, y: np.ndarray, held: np.ndarray, width: int) -> np.ndarray:
    """The features, sorted, that a model of the rows marked in `held` uses; they depend on the labels only."""
    n, pos = int(held.sum()), y[held].sum()
    if pos < 2 or n - pos < 2:
        return np.zeros(0, np.int64)
    total = tally(rows, hashes, held, width)
    found = np.flatnonzero((total >= 4) & (total <= n - 4))
    total = total[found].astype(np.int64)
    a = tally(rows, hashes, held & (y > 0), width)[found].astype(np.int64)
    b, c, d = total - a, pos - a, n - pos - (total - a)
    chi = n * (np.abs(a * d - b * c) - n / 2).clip(0) ** 2 / (total * (n - total) * pos * (n - pos))
    best = np.argsort(-chi, kind="stable")[:MAX_FEATURES]
    return np.sort(found[best[chi[best] >= CHI_SQUARE]])


def fit(rows: np.ndarray, hashes: np.ndarray, dense: np.ndarray, y: np.ndarray, ridge: float = RIDGE, width: int = 1 << HASH_BITS) -> Model:
    """Logistic regression on distinct (row, hash) pairs, hashes being below `width`, and dense columns."""
    n, pos = len(y), y.sum()
    if not n:
        return Model(np.zeros(0, np.uint32), np.zeros(0), np.zeros(dense.shape[1]), np.zeros(dense.shape[1]), np.ones(dense.shape[1]), 0.0)
    mean, scale = dense.mean(axis=0), np.maximum(dense.std(axis=0), 1e-9)
    rate = (pos + 0.5) / (n + 1)
    empty = Model(np.zeros(0, np.uint32), np.zeros(0), np.zeros(dense.shape[1]), mean, scale, float(np.log(rate / (1 - rate))))
    if pos < 2 or n - pos < 2:
        return empty
    chosen = select(rows, hashes, y, np.ones(n, bool), width)
    place = np.full(width, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    held = place[hashes] >= 0
    r, j = rows[held], place[hashes[held]]
    z = (dense - mean) / scale
    m, k = len(chosen), dense.shape[1]
    w = np.append(np.zeros(m + k), empty.bias)

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        odds = np.bincount(r, v[j], n) + z @ v[m : m + k] + v[-1]
        e = 1 / (1 + np.exp(-np.clip(odds, -30, 30))) - y
        g = np.concatenate([np.bincount(j, e[r], m), e @ z, [e.sum()]])
        g[:-1] += ridge * v[:-1]
        return float((np.logaddexp(0, odds) - y * odds).sum() + ridge / 2 * (v[:-1] ** 2).sum()), g

    w = minimum(loss, w)
    return Model(chosen.astype(np.uint32), w[:m], w[m : m + k], mean, scale, float(w[-1]))


@dataclass
class Chain:
    categories: list[str]
    models: list[Model]
    thresholds: list[float]  # log-odds from which a category is assigned


def threshold(odds: np.ndarray, y: np.ndarray) -> float:
    """The log-odds of best F1 on out-of-fold predictions, in the middle of the gap below it; none without positives."""
    if not y.any():
        return float("inf")
    order = np.argsort(-odds, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    k = int(f1.argmax())
    return float((odds[order[k]] + odds[order[min(k + 1, len(y) - 1)]]) / 2)


def narrowed(rows: np.ndarray, hashes: np.ndarray, labels: dict[str, np.ndarray], folds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs, those whose feature some model of the chain uses: features, sorted, then the pairs' rows and places
    among the features. No model differs without the others."""
    used = np.zeros(1 << HASH_BITS, bool)
    for y in labels.values():
        for f in range(-1, FOLDS):
            used[select(rows, hashes, y, folds != f, len(used))] = True
    features = np.flatnonzero(used).astype(np.uint32)
    place = np.zeros(len(used), np.int32)
    place[features] = np.arange(len(features))
    parts = []
    for i in range(0, len(rows), CHUNK):
        h = hashes[i : i + CHUNK]
        own = used[h]
        parts.append((rows[i : i + CHUNK][own], place[h[own]]))
    return features, *(np.concatenate([x[k] for x in parts]) if parts else np.zeros(0, np.int32) for k in range(2))


def fit_chain(rows: np.ndarray, hashes: np.ndarray, dense: np.ndarray, labels: dict[str, np.ndarray], folds: np.ndarray) -> Chain:
    """Fit all links: each on out-of-fold log-odds of those before it."""
    out = Chain(list(labels), [], [])
    features, rows, places = narrowed(rows, hashes, labels, folds)
    width = len(features)
    for y in labels.values():
        held_out = np.zeros(len(y))
        for f in range(FOLDS):
            train = folds != f
            index = (np.cumsum(train) - 1).astype(np.int32)
            own = train[rows]
            model = fit(index[rows[own]], places[own], dense[train], y[train], width=width)
            sparse = np.bincount(rows, model.table(width)[places], len(y))
            held_out[~train] = model.log_odds(sparse, dense)[~train]
        model = fit(rows, places, dense, y, width=width)
        model.features = features[model.features]
        out.models.append(model)
        out.thresholds.append(threshold(held_out, y))
        dense = np.concatenate([dense, np.clip(held_out, -12, 12)[:, None]], axis=1)
    return out


def distinct(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique(rows.astype(np.uint64) << np.uint64(32) | hashes)
    return (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> Chain:
    """Fit the chain on at most `fit_rows` labelled documents, those of the smallest hashes of doc_id, and at most
    `fit_bytes` of their features. `categories` names each category's SQL condition on the labels. The executors send
    hashed features; no text comes to the driver."""
    named = labels.filter("doc_id IS NOT NULL").select("doc_id", *(F.expr(c).cast("int").alias(f"__{k}") for k, c in enumerate(categories.values())))
    names = [f"__{k}" for k in range(len(categories))]
    named = named.dropna().groupBy("doc_id").agg(*(F.max(n).alias(n) for n in names))
    named = named.join(F.broadcast(sample_keys(named.select("doc_id"), fit_rows)), "doc_id")  # at most fit_rows ids

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in V.slices(batches):
            hashes, rows, style, _ = text_features(batch.column("text"))
            rows, hashes = distinct(rows, hashes)
            edge = np.searchsorted(rows, np.arange(len(batch) + 1))
            out = {n: batch.column(n) for n in ("doc_id", *names)}
            out["features"] = pa.array([hashes[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_pydict(out | {"style": pa.array(list(style), pa.list_(pa.float64()))})

    sample = docs.select("doc_id", "text").join(F.broadcast(named), "doc_id").mapInArrow(extract, f"doc_id long, {', '.join(f'{n} int' for n in names)}, features binary, style array<double>")
    sample = materialize(sample.withColumn("size", F.octet_length("features")), "toxicity-sample")
    sizes = sample.groupBy("doc_id").agg(F.sum("size").alias("size"), F.xxhash64("doc_id").alias("hash")).orderBy("hash", "doc_id").toPandas()  # at most fit_rows rows
    sizes = sizes[sizes["size"].cumsum() <= fit_bytes]
    if not len(sizes):
        return Chain(list(categories), [], [])
    found = sorted(sample.filter(F.xxhash64("doc_id") <= int(sizes["hash"].max())).toLocalIterator(), key=lambda r: (r.doc_id, r.features))
    counts = [len(r.features) // 4 for r in found]
    rows, hashes = np.repeat(np.arange(len(found), dtype=np.int32), counts), np.concatenate([np.frombuffer(r.features, np.uint32) for r in found])
    y = {name: np.array([r[f"__{k}"] for r in found], float) for k, name in enumerate(categories)}
    folds = (V.mix(np.array([r.doc_id for r in found], np.int64).view(np.uint64)) % np.uint64(FOLDS)).astype(int)
    dense = np.array([r.style for r in found])
    del found
    return fit_chain(rows, hashes, dense, y, folds)


def score(docs: DataFrame, chain: Chain, *, carry: tuple[str, ...] = ()) -> DataFrame:
    """Add p_<category> (probability) and is_<category> for each category of the chain."""
    spark = docs.sparkSession
    docs = V.chosen(docs, "doc_id", "text", carry, tuple(f"{sign}_{c}" for c in chain.categories for sign in ("p", "is")))
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"`p_{c}` double, `is_{c}` boolean" for c in chain.categories)])
    model = spark.sparkContext.broadcast(chain)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = model.value
        tables = [m.table() for m in chain.models]
        for batch in V.slices(batches):
            hashes, rows, dense, words = text_features(batch.column("text"))
            used = np.zeros(len(hashes), bool)
            for t in tables:
                used |= t[hashes] != 0
            rows, hashes = distinct(rows[used], hashes[used])
            out = {n: batch.column(n) for n in batch.schema.names}
            for k, name in enumerate(chain.categories):
                if not chain.models:
                    p, held = np.zeros(len(batch)), np.zeros(len(batch), bool)
                else:
                    odds = chain.models[k].log_odds(np.bincount(rows, tables[k][hashes], len(batch)), dense)
                    dense = np.concatenate([dense, np.clip(odds, -12, 12)[:, None]], axis=1)
                    p = np.where(words > 0, 1 / (1 + np.exp(-np.clip(odds, -500, 500))), 0.0)
                    held = (odds >= chain.thresholds[k]) & (words > 0)
                out |= {f"p_{name}": pa.array(p), f"is_{name}": pa.array(held)}
            yield pa.RecordBatch.from_pydict(out)

    return docs.mapInArrow(apply, fields)


CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}


def toxicity(docs: DataFrame, labels: DataFrame, *, categories: dict[str, str] | Sequence[str] = CATEGORIES, carry: tuple[str, ...] = (), fit_rows: int = FIT_ROWS) -> DataFrame:
    """Train the chain on the labelled documents and score all documents.

    Returns doc_id, text, the columns in `carry`, and p_ and is_ columns of each category. Edge cases: a null or
    empty text, or one without words, has probability 0 and no category; labels with a null, or of unknown
    documents, are not used; of several labels of one document the largest of each category counts; without labelled
    documents, or with one class only, nothing is assigned that the labels do not show; repeated rows are scored one
    by one; an empty table gives an empty result; other columns play no part, and a carried column that bears the
    name of a result is replaced by it. The whole text is scored, however long. `fit_rows` and FIT_BYTES bound the
    training sample, not the scoring.
    """
    return score(docs, train(docs, labels, dict(categories), fit_rows), carry=carry)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities and decisions for all documents; `is_toxic` rejects."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text")
