"""Quality by importance resampling: target against raw text under hashed n-gram models.

Two generative models over hashed n-grams are counted over whole texts: the target from documents
known to be good, the raw one from all documents. A document's log ratio is the mean over its n-grams
of log target share minus log raw share; its log weight is that of a text of ``GRAMS`` n-grams, so
that length does not decide. Documents are drawn without replacement in proportion to their weights
by Gumbel top-k: the k largest of log weight plus noise, which comes from a hash of the document's
id. k is the number of documents that the target model explains about as well as the raw one (at
most ``SLACK`` nats per n-gram worse), so it follows the corpus.

n-grams are of byte triples and of word shapes (case, length, marks, closing mark, whether the word
repeats one just before), so they speak of form, not of topic. Both families have their own buckets
and share a model each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ecoc import BUCKETS as TRIPLES
from .ecoc import gram_index
from .shared import lookup, stored
from .text import LOWER, SMALL_BLOCK, SPACED, blocks, flat, mix, span_hash, spans

SHAPES = 1 << 13
BUCKETS = TRIPLES + SHAPES
#: counts are lifted by this much per bucket
LIFT = 0.5
GRAMS, SLACK = 100, 0.4
BINS, FEW = 1024, 10_000

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def shape_index(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every 1-, 2- and 3-gram of word shapes."""
    data, off = flat(texts)
    start, end, row = spans(data, off, SPACED)
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.int64)

    def inside(kind: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(kind[data])])
        return total[end] - total[start]

    size = end - start
    upper, digit, mark = inside(_UPPER), inside(_DIGIT), inside(_MARK)
    last = np.where(_MARK[data[end - 1]], data[end - 1], 0).astype(np.int64)
    word = span_hash(LOWER[data], start, end)
    again = np.zeros(len(start), bool)
    for back in (1, 2, 3):
        again[back:] |= (word[back:] == word[:-back]) & (row[back:] == row[:-back])
    shape = np.minimum(np.log2(size).astype(np.int64), 5)
    for part, most in ((np.minimum(upper, 2), 3), (np.minimum(digit, 2), 3), (np.minimum(mark, 3), 4),
                       (last, 128), (again.astype(np.int64), 2)):
        shape = shape * most + part
    shape = shape.astype(np.uint64)
    keys, rows, h = [], [], np.zeros(len(shape), np.uint64)
    for n in range(3):
        if len(shape) <= n:
            break
        h = mix(h[:len(shape) - n] + shape[n:] * np.uint64(2 * n + 3) + np.uint64(n))
        one = row[:len(shape) - n] == row[n:]
        keys.append((h[one] % np.uint64(SHAPES)).astype(np.int64))
        rows.append(row[:len(shape) - n][one])
    return np.concatenate(keys), np.concatenate(rows)


def index(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of all n-grams of both families."""
    triples, row = gram_index(texts)
    shapes, shape_row = shape_index(texts)
    return np.concatenate([triples, shapes + TRIPLES]), np.concatenate([row, shape_row])


def log_ratio(docs: DataFrame, good: DataFrame) -> np.ndarray:
    """Log of target share over raw share, per bucket. ``good`` has the doc_id of known good rows.

    Counts are over all documents. What comes to the driver is ``BUCKETS`` rows.
    """
    def run(batches):
        target, raw = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for block in blocks(batch, 1, SMALL_BLOCK):
                key, row = index(block.column(1))
                is_good = block.column(0).to_numpy(zero_copy_only=False).astype(bool)
                raw += np.bincount(key, minlength=BUCKETS)
                target += np.bincount(key[is_good[row]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(target[some]), pa.array(raw[some])],
                                         names=["bucket", "target", "raw"])

    known = good.select("doc_id").distinct().withColumn("good", F.lit(True))
    marked = docs.join(lookup(known), "doc_id", "left")
    found = marked.select(F.coalesce("good", F.lit(False)), "text").mapInArrow(
        run, "bucket long, target long, raw long").groupBy("bucket").agg(
        F.sum("target").alias("target"), F.sum("raw").alias("raw")).toPandas()
    counts = np.zeros((2, BUCKETS))
    counts[0, found["bucket"]], counts[1, found["bucket"]] = found["target"], found["raw"]
    if not counts[0].any():
        return np.zeros(BUCKETS)
    out = np.empty(BUCKETS)
    for family in (slice(0, TRIPLES), slice(TRIPLES, BUCKETS)):
        share = counts[:, family] + LIFT
        share /= share.sum(1, keepdims=True)
        out[family] = np.log(share[0] / share[1])
    return out


def weights(docs: DataFrame, ratio: np.ndarray, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of every document, its n_grams, mean_ratio and log_weight."""
    rows = docs.select(*keep, "text")
    n_keep = len(keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:n_keep])

    def run(batches):
        for batch in batches:
            for block in blocks(batch, n_keep, SMALL_BLOCK):
                key, row = index(block.column(n_keep))
                n = np.bincount(row, minlength=block.num_rows)
                total = np.bincount(row, weights=ratio[key], minlength=block.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [*block.columns[:n_keep], pa.array(n), pa.array(total / np.maximum(n, 1))],
                    names=[*keep, "n_grams", "mean_ratio"])

    return rows.mapInArrow(run, f"{fields}, n_grams long, mean_ratio double").withColumn(
        "log_weight", GRAMS * F.col("mean_ratio"))


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The k-th largest value: histograms narrow the range down to at most ``FEW`` values."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    above = 0
    while low < high:
        width = (high - low) / BINS
        inside = df.filter(F.col(column).between(low, high))
        bins = {r.bin: (r.n, r.a, r.z) for r in inside.groupBy(F.least(
            F.lit(BINS - 1), F.floor((F.col(column) - low) / width)).alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min(column).alias("a"), F.max(column).alias("z")).collect()}
        for i in sorted(bins, reverse=True):
            n, a, z = bins[i]
            if above + n >= k:
                break
            above += n
        low, high = a, z
        if n <= FEW:
            values = sorted((r[0] for r in df.filter(F.col(column).between(low, high)).select(
                column).collect()), reverse=True)
            return values[k - above - 1]
    return low


def resample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, n_grams, mean_ratio, log_weight, kept.

    Good documents are those with ``quality`` 1 in ``labels``; without any, all weights are 0. Null
    and empty texts have no n-grams and weight 0, which is no ground to reject them. Documents whose
    keys tie with the k-th are all kept. Rows that share a ``doc_id`` are weighed each on its own;
    an empty table gives no rows; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    good = labels.filter(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("doc_id"))
    weighed = stored(weights(docs, log_ratio(docs, good), ["doc_id"]), "weights")
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", "n_grams"), 11) + 0.5) / float(1 << 53)
    keyed = weighed.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform)))
    k = keyed.filter(F.col("mean_ratio") >= -SLACK).count()
    least = kth_largest(keyed, "key", k) if k else float("inf")
    return keyed.select("doc_id", "n_grams", "mean_ratio", "log_weight",
                        (F.col("key") >= least).alias("kept"))
