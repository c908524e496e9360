"""Toxicity by non-negative positive-unlabelled learning.

Known toxic documents are the positives; all other training documents are unlabelled, whatever their
label. A linear classifier over the presence of words and word beginnings minimises the risk that
the class prior corrects: pi * R+(p) + max(0, R-(u) - pi * R-(p)). When the second part would turn
negative the step goes the other way, so the classifier does not learn unlabelled toxic texts by
heart. Equal texts count once on both sides and in the prior, which is the share of toxic ones among
the labelled training texts at hand.

The fit reads a bounded sample, the first ``POSITIVES`` and ``UNLABELLED`` texts by hash of
``doc_id``, each of them whole: Spark counts the documents of every feature, and only the selected
features of each text reach the driver. Scoring reads every whole text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored
from .text import ALNUM, LOWER, SMALL_BLOCK, blocks, flat, span_hash, spans

POSITIVES, UNLABELLED = 3000, 5000
SELECTED = 4096
#: a selected feature is in so many positives, and at least this share of its documents are toxic
MIN_SUPPORT, LEAST_SHARE = 3, 0.6
#: a word gives itself and its first bytes
BEGINNINGS = (4, 5, 6)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every feature, repeats included; case is ignored in ASCII."""
    data, off = flat(texts)
    data = LOWER[data]
    start, end, row = spans(data, off, ALNUM)
    keys, rows = [span_hash(data, start, end)], [row]
    for size in BEGINNINGS:
        longer = end - start > size
        keys.append(span_hash(data, start[longer], start[longer] + size) + np.uint64(size))
        rows.append(row[longer])
    return np.concatenate(keys), np.concatenate(rows)


def _sample(rows: DataFrame, n: int) -> DataFrame:
    return rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def _features_once(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of the distinct features of each text, in order."""
    key, row = features(texts)
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    return key[new], row[new]


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of the wanted documents, written; of those with the same features one."""
    def run(batches):
        for batch in batches:
            for block in blocks(batch, 0, SMALL_BLOCK):
                key, row = _features_once(block.column(0))
                first = np.searchsorted(row, np.arange(block.num_rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [block.column(0), pa.array([hashlib.sha256(key[a:b].tobytes()).digest()
                                                for a, b in zip(first, first[1:])], pa.binary())],
                    names=["text", "same"])

    # at most POSITIVES or UNLABELLED ids
    mine = docs.join(F.broadcast(wanted), "doc_id", "left_semi").select("text")
    once = mine.mapInArrow(run, "text string, same binary").groupBy("same").agg(F.min("text").alias("text"))
    return stored(once.select("text"), "fit-texts")


def _document_counts(texts: DataFrame, name: str) -> DataFrame:
    """Per feature (its hash as a signed number), the number of texts that have it."""
    def run(batches):
        for batch in batches:
            for block in blocks(batch, 0, SMALL_BLOCK):
                key, n = np.unique(_features_once(block.column(0))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)],
                                                 names=["key", "n"])

    return texts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias(name))


def _columns(texts: DataFrame, keys: np.ndarray) -> list[np.ndarray]:
    """Per text, which of the selected features it has."""
    def run(batches):
        for batch in batches:
            for block in blocks(batch, 0, SMALL_BLOCK):
                key, row = _features_once(block.column(0))
                near = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
                hit = keys[near] == key if len(keys) else np.zeros(len(key), bool)
                near, row = near[hit].astype(np.int16), row[hit]
                first = np.searchsorted(row, np.arange(block.num_rows + 1))
                yield pa.RecordBatch.from_arrays([pa.array(
                    [near[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary())], names=["f"])

    found = sorted(bytes(r.f) for r in texts.mapInArrow(run, "f binary").collect())
    return [np.frombuffer(f, np.int16) for f in found]


class Model:
    """Sorted feature hashes, their weights and a bias."""

    def __init__(self, keys=(), weights=(), bias: float = -10.0):
        self.keys, self.weights, self.bias = np.array(keys, np.uint64), np.array(weights), bias

    def score(self, texts: pa.Array) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        if len(self.keys):
            key, row = features(texts)
            near = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[near] == key
            pairs = np.unique(row[hit] * len(self.keys) + near[hit])
            z += np.bincount(pairs // len(self.keys), weights=self.weights[pairs % len(self.keys)],
                             minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def select(key: np.ndarray, p: np.ndarray, u: np.ndarray, n_p: int, n_u: int, prior: float
           ) -> np.ndarray:
    """The features that tell positives most, by log-likelihood ratio, of those whose documents are
    mostly toxic by the class prior; ``p`` of the ``n_p`` positives and ``u`` of the ``n_u``
    unlabelled documents have the feature. A ratio must exceed what the best of so many candidates
    would reach by chance, so small samples learn from few words and large ones stay strict."""
    a, b = p / n_p, u / max(n_u, 1)
    both = (p + u) / (n_p + n_u)
    gain = p * np.log(a / both) + np.where(u > 0, u * np.log(np.maximum(b, 1e-12) / both), 0)
    gain[(a * prior < LEAST_SHARE * b) | (p < MIN_SUPPORT)] = 0
    gain[gain < np.log(max(2, np.count_nonzero(gain)))] = 0
    best = np.argsort(-gain, kind="stable")[:SELECTED]
    return np.sort(key[best[gain[best] > 0]])


def _distinct(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Copies among the positives count once."""
    return [np.frombuffer(b, np.uint64) for b in sorted({r.tobytes() for r in rows})]


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """Selection and descent for the features of texts at hand."""
    if not positive:
        return Model()
    positive = _distinct(positive)
    key, p = np.unique(np.concatenate(positive), return_counts=True)
    other, n = np.unique(np.concatenate([np.empty(0, np.uint64), *unlabelled]), return_counts=True)
    at = np.minimum(np.searchsorted(other, key), max(len(other) - 1, 0))
    u = np.where(other[at] == key, n[at], 0) if len(other) else np.zeros(len(key))
    keys = select(key, p, u, len(positive), len(unlabelled), prior)
    return descend(keys, *([np.flatnonzero(np.isin(keys, r, assume_unique=True)) for r in rows]
                           for rows in (positive, unlabelled)), prior)


def descend(keys: np.ndarray, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float,
            steps: int = 600, rate: float = 0.1, decay: float = 2e-5) -> Model:
    """Adam on the non-negative risk with sigmoid loss, whole sample per step; a document is the
    places of its features in ``keys``. The loss is bounded: surely toxic texts cannot turn the
    second part of the risk negative by their scores alone, which would lift all other scores."""
    columns = rows = positive + unlabelled
    row = np.repeat(np.arange(len(rows)), [len(c) for c in columns])
    column = np.concatenate(columns).astype(np.int64)
    n_p = len(positive)
    w, moment, square = (np.zeros(len(keys) + 1) for _ in range(3))
    w[-1] = -2.0
    for step in range(1, steps + 1):
        z = np.bincount(row, weights=w[column], minlength=len(rows)) + w[-1]
        minus = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        slope = minus * (1 - minus)
        negative = minus[n_p:].mean() - prior * minus[:n_p].mean() if unlabelled else 0.0
        g = np.zeros(len(rows))
        if negative >= 0:
            g[:n_p] = -2 * prior * slope[:n_p] / n_p
            g[n_p:] = slope[n_p:] / max(len(unlabelled), 1)
        else:
            g[:n_p] = prior * slope[:n_p] / n_p
            g[n_p:] = -slope[n_p:] / max(len(unlabelled), 1)
        grad = np.append(np.bincount(column, weights=g[row], minlength=len(keys)), g.sum()) \
            + decay * np.append(w[:-1], 0)
        moment = 0.9 * moment + 0.1 * grad
        square = 0.999 * square + 0.001 * grad**2
        w -= rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Model(keys, w[:-1], float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, in_training: Column) -> Model:
    """Fit on the rows for which ``in_training`` (an expression over doc_id) holds."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(in_training)
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter(in_training)
    known = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    hashed = docs.filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("same"))
    texts = stored(hashed.join(known, "doc_id", "left").groupBy("same").agg(
        F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")), "texts-once")
    rate = texts.agg(F.avg(F.col("toxic").cast("double")).alias("p")).first()["p"]
    if not rate:
        return Model()
    positive = _texts(docs, _sample(texts.filter("toxic = 1"), POSITIVES))
    unlabelled = _texts(docs, _sample(texts, UNLABELLED))
    n_p, n_u, prior = positive.count(), unlabelled.count(), float(rate)
    # select() takes none of the features left out here
    mostly = F.col("p") / n_p * prior >= LEAST_SHARE * F.col("u") / max(n_u, 1) * (1 - 1e-9)
    seen = _document_counts(positive, "p").filter(F.col("p") >= MIN_SUPPORT).join(
        _document_counts(unlabelled, "u"), "key", "left").fillna(0, ["u"]).filter(mostly).toArrow()
    key, p, u = (seen.column(c).to_numpy() for c in ("key", "p", "u"))
    key = key.astype(np.int64).view(np.uint64)
    order = np.argsort(key)
    keys = select(key[order], p[order], u[order], n_p, n_u, prior)
    return descend(keys, _columns(positive, keys), _columns(unlabelled, keys), prior)


def score(docs: DataFrame, model: Model, *keep: Column) -> DataFrame:
    """Per document: the ``keep`` columns, score (0 to 1), predicted (1 from 0.5 on).

    Null and empty texts get the score of a text without features. Rows that share a ``doc_id`` are
    scored each on its own; an empty table gives no rows; other columns are not read. Without toxic
    training documents every score is next to 0.
    """
    rows = docs.select(*keep, "text")
    *kept, _ = rows.columns
    n_keep = len(kept)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:n_keep])

    def run(batches):
        for batch in batches:
            for block in blocks(batch, n_keep, SMALL_BLOCK):
                value = model.score(block.column(n_keep))
                yield pa.RecordBatch.from_arrays(
                    [*block.columns[:n_keep], pa.array(value),
                     pa.array((value >= 0.5).astype(np.int32))],
                    names=[*kept, "score", "predicted"])

    return rows.mapInArrow(run, f"{fields}, score double, predicted int")
