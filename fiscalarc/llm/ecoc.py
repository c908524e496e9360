"""Language identification by error-correcting output codes over hashed byte n-grams.

Every language has a codeword. For each bit a binary classifier holds the byte n-grams of the
languages with the bit set against those without (log odds of smoothed counts, over all training
texts). A text gives one margin per bit; decoding takes the codeword with the least logistic loss,
each bit weighted by how often its classifier is right on the training texts of that language. The
score is the share of the best codeword, and a text whose best two lie close is flagged.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import LOWER, blocks, flat

GRAM = 3
BUCKETS = 1 << 14
#: margins are divided by this many nats per square root of a text's length
SCALE = 0.5
AMBIGUOUS = 0.9


def codewords(n: int) -> np.ndarray:
    """One row of +1 and -1 per language: all distinct splits up to 5 languages, else the most
    distant of a few seeded random codes of about 10 log2(n) bits."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 5:
        rows = [(1, *rest) for rest in itertools.product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(rows).T.astype(float)
    bits = max(15, int(np.ceil(10 * np.log2(n))))
    rng, best, most = np.random.default_rng(11), None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (n, bits))
        near = int(((bits - code @ code.T) / 2 + bits * np.eye(n)).min())
        if near > most and (abs(code.sum(0)) < n).all():
            best, most = code, near
    return best


def gram_index(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every n-gram of bytes; ASCII letters in lower case, white space alike."""
    data, off = flat(texts)
    if len(data) < GRAM:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    data = LOWER[data]
    data = np.where((data >= 9) & (data <= 13), np.uint8(32), data).astype(np.uint32)
    n = len(data) - GRAM + 1
    key = np.zeros(n, np.uint32)
    for i in range(GRAM):
        key = key * np.uint32(257) + data[i:n + i]
    bucket = ((key * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    inside = row[:n] == row[GRAM - 1:]
    return bucket[inside], row[:n][inside]


def count_grams(rows: DataFrame) -> DataFrame:
    """n-gram counts per language of (lang, text): lang, gram, n."""
    def run(batches):
        held: dict[str, np.ndarray] = {}

        def out():
            for lang, n in held.items():
                gram = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(gram), pa.string()), pa.array(gram, pa.int64()),
                     pa.array(n[gram])], names=["lang", "gram", "n"])

        for batch in batches:
            for block in blocks(batch, 1):
                langs = block.column(0).dictionary_encode()
                index, row = gram_index(block.column(1))
                code = langs.indices.to_numpy(zero_copy_only=False)[row]
                counts = np.bincount(code * BUCKETS + index, minlength=len(langs.dictionary) * BUCKETS)
                for i, lang in enumerate(langs.dictionary.to_pylist()):
                    mine = counts[i * BUCKETS:(i + 1) * BUCKETS]
                    held[lang] = held[lang] + mine if lang in held else mine
                if len(held) > 64:
                    yield from out()
                    held = {}
        yield from out()

    return rows.mapInArrow(run, "lang string, gram long, n long") \
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Weights per n-gram and bit, codewords and the weight of each bit per language."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.code = langs, codewords(len(langs))
        log_odds = []
        for bit in self.code.T:
            sides = []
            for sign in (1, -1):
                # each language counts alike, however much text it has
                mine = counts[bit == sign]
                share = (mine + 0.5) / (mine.sum(1, keepdims=True) + 0.5 * BUCKETS)
                sides.append(share.mean(0) if len(mine) else np.full(BUCKETS, 1 / BUCKETS))
            log_odds.append(np.log(sides[0] / sides[1]))
        self.weights = np.array(log_odds, np.float32).T.copy()
        self.trust = np.ones(self.code.shape)

    def margins(self, texts: pa.Array) -> np.ndarray:
        """One number per text and bit."""
        index, row = gram_index(texts)
        out = np.zeros((len(texts), self.code.shape[1]))
        if len(index):
            start = np.flatnonzero(np.concatenate([[True], np.diff(row) > 0]))
            out[row[start]] = np.add.reduceat(self.weights[index], start, axis=0, dtype=np.float64)
            size = np.bincount(row, minlength=len(texts))[:, None]
            out /= SCALE * np.sqrt(np.maximum(size, 1))
        return out

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its score, and the second score, per text."""
        agreement = margins[:, None, :] * self.code[None]
        loss = (np.logaddexp(0, -agreement) * self.trust[None]).sum(2)
        share = np.exp(loss.min(1, keepdims=True) - loss)
        share /= share.sum(1, keepdims=True)
        best = share.argmax(1)
        score = share.max(1)
        share[np.arange(len(share)), best] = 0
        return best, score, share.max(1)


def train(rows: DataFrame) -> Model | None:
    """Fit on all rows of (lang, text); null languages and texts are left out. None without rows.

    What comes to the driver is bounded by the number of languages: ``BUCKETS`` counts and a few
    bit rates for each.
    """
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = count_grams(rows).toPandas()
    if not len(found):
        return None
    langs = sorted(found["lang"].unique())
    counts = np.zeros((len(langs), BUCKETS))
    counts[np.searchsorted(langs, found["lang"]), found["gram"]] = found["n"]
    model = Model(langs, counts)

    def right(batches):
        hit = np.zeros(model.code.shape)
        n = np.zeros(len(langs))
        for batch in batches:
            for block in blocks(batch, 1):
                lang = np.searchsorted(langs, block.column(0).to_pylist())
                good = model.margins(block.column(1)) * model.code[lang] > 0
                np.add.at(hit, lang, good)
                np.add.at(n, lang, 1)
        lang, bit = np.indices(hit.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang.ravel()), pa.array(bit.ravel()), pa.array(hit.ravel()),
             pa.array(np.repeat(n, hit.shape[1]))], names=["lang", "bit", "hit", "n"])

    rates = rows.mapInArrow(right, "lang long, bit long, hit double, n double").groupBy(
        "lang", "bit").agg((F.sum("hit") / F.greatest(F.sum("n"), F.lit(1.0))).alias("rate")).toPandas()
    model.trust[rates["lang"], rates["bit"]] = rates["rate"]
    model.trust *= model.code.shape[1] / np.maximum(model.trust.sum(1, keepdims=True), 1e-9)
    return model


def _lettered(texts: pa.Array) -> np.ndarray:
    data, off = flat(texts)
    letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    total = np.concatenate([[0], np.cumsum(letter)])
    has = total[off[1:]] > total[off[:-1]]
    for i in np.flatnonzero(~has).tolist():
        text = texts[i].as_py()
        has[i] = bool(text) and any(c.isalpha() for c in text)
    return has


def identify(docs: DataFrame, model: Model | None, *keep: Column) -> DataFrame:
    """Per document: the ``keep`` columns, lang_pred, score, ambiguous.

    The whole text is read. ``und`` with score 0 if the text is null or has no letter, or without a
    model. Rows that share a ``doc_id`` are judged each on its own; ties go to the first language in
    alphabetical order; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(*keep, "text")
    *kept, _ = rows.columns
    n_keep = len(kept)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:n_keep])

    def run(batches):
        for batch in batches:
            for block in blocks(batch, n_keep):
                texts = block.column(n_keep)
                n = block.num_rows
                if model is None:
                    langs, score, close = ["und"] * n, np.zeros(n), np.ones(n, bool)
                else:
                    best, score, second = model.decode(model.margins(texts))
                    known = _lettered(texts)
                    langs = [model.langs[b] if k else "und" for b, k in zip(best, known)]
                    score = np.where(known, np.clip(score, 0, 1), 0.0)
                    close = ~known | (second > (1 - AMBIGUOUS) * score)
                yield pa.RecordBatch.from_arrays(
                    [*block.columns[:n_keep], pa.array(langs, pa.string()), pa.array(score),
                     pa.array(close)], names=[*kept, "lang_pred", "score", "ambiguous"])

    return rows.mapInArrow(run, f"{fields}, lang_pred string, score double, ambiguous boolean")
