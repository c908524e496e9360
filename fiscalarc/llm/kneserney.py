"""Interpolated modified Kneser-Ney word model: counted in Spark, sorted hash arrays in files.

Counting: blocks of training texts send their distinct words and word pairs with counts, sorted and
packed, to hash ranges. A range adds up its pairs, writes them as one sorted array of hashes with
their counts, and passes on what the lower order needs: per first word the total and how many pairs
occur once, twice or more, per second word the number of different words before it. Those meet in
ranges of their own. So no word, however common, gathers more than one entry per block or range.

Scoring: workers map the files of the shared folder into memory and look up the sorted distinct
words and pairs of a block of texts.

Words are named by 64-bit hashes; in pairs by 32 bits of them, so that a pair's hash (a bijection of
both) gives back its words. The model is of second order: the array of third-order hashes alone
would be larger than the text. Probabilities of all words and one unknown word add up to 1.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import mounted
from .text import SPACED, blocks, mix, pack_sorted, runs, unpack_sorted, word_hashes

BEGIN, END = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)
CHUNK_TOKENS = 1_200_000
RANGE_KEYS = 2_000_000
WORD, PAIR, FIRST, SECOND = range(4)
#: pair counts from here on stand in a file of their own
FULL = 65535


def unmix(x: np.ndarray) -> np.ndarray:
    """Inverse of ``mix``."""
    x = x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x = x * np.uint64(pow(0x94D049BB133111EB, -1, 2**64))
    x = x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x = x * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 2**64))
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts, an end after each; the row of each; and the pair hashes."""
    words, row = word_hashes(texts, SPACED)
    n = np.bincount(row, minlength=len(texts))
    stop = np.cumsum(n)
    words, row = np.insert(words, stop, END), np.insert(row, stop, np.arange(len(texts)))
    before = np.empty(len(words), np.uint64)
    before[1:] = words[:-1]
    before[np.concatenate([[0], stop[:-1] + np.arange(1, len(texts))])] = BEGIN
    short = np.uint64(32)
    return words, row, mix((before >> short << short) | (words >> short))


def added(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their values (rows of a matrix or numbers)."""
    order = np.argsort(keys, kind="stable")
    start, _ = runs(keys[order])
    if not len(start):
        return keys, values
    return keys[order][start], np.add.reduceat(values[order], start, axis=0)


def range_of(keys: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The hash range of sorted keys, as edges: range r has keys[edge[r]:edge[r + 1]]."""
    width = 2**bits // n + 1
    starts = np.array([min(r * width, 2**64 - 1) for r in range(n)], np.uint64)
    return np.append(np.searchsorted(keys, starts), len(keys))


def _rows(kind: int, keys: np.ndarray, values: np.ndarray, n: int, bits: int) -> list[tuple]:
    edge = range_of(keys, n, bits)
    return [(kind, r, pack_sorted(keys[edge[r]:edge[r + 1]]),
             values[edge[r]:edge[r + 1]].astype("<u4").tobytes())
            for r in np.flatnonzero(np.diff(edge)).tolist()]


_FIELDS = "kind int, range int, keys binary, counts binary, stats array<long>"
_TYPE = pa.schema([("kind", pa.int32()), ("range", pa.int32()), ("keys", pa.binary()),
                   ("counts", pa.binary()), ("stats", pa.list_(pa.int64()))])


def _batch(rows: list[tuple]) -> list[pa.Array]:
    columns = list(zip(*rows)) if rows else [()] * 4
    return [pa.array(c, t.type) for c, t in zip([*columns[:4], [None] * len(rows) if len(columns) < 5
                                                 else columns[4]], _TYPE)]


def _counter(n_ranges: int):
    def run(batches: Iterator[pa.RecordBatch]):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out():
            made = []
            for kind, keys in ((WORD, [w for w, _ in held]), (PAIR, [p for _, p in held])):
                every = np.sort(np.concatenate(keys))
                start, n = runs(every)
                made += _rows(kind, every[start], n, n_ranges, 64)
            held.clear()
            return pa.RecordBatch.from_arrays(_batch(made), schema=_TYPE)

        for batch in batches:
            for block in blocks(batch, 0):
                words, _, pairs = tokens(block.column(0))
                held.append((words, pairs))
                size += len(words)
                if size >= CHUNK_TOKENS:
                    yield out()
                    size = 0
        if held:
            yield out()

    return run


def _write(path: str, array: np.ndarray) -> None:
    scratch = f"{path}.{uuid.uuid4().hex}"
    array.tofile(scratch)
    os.replace(scratch, path)


def _count_classes(n: np.ndarray) -> list[int]:
    return [int((n == i).sum()) for i in (1, 2, 3, 4)]


def _gather(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([unpack_sorted(x.as_py()) for x in table["keys"]])
    counts = np.frombuffer(b"".join(x.as_py() for x in table["counts"]), "<u4").astype(np.int64)
    return added(keys, counts.reshape(-1, width) if width > 1 else counts)


def _add_range(folder: str, n_lower: int, full: int):
    """Add up one range of words or pairs, write it, pass on what the lower order needs."""
    def run(table: pa.Table) -> pa.Table:
        kind, r = table["kind"][0].as_py(), table["range"][0].as_py()
        keys, n = _gather(table, 1)
        name = f"{folder}/{kind}-{r}"
        os.makedirs(folder, exist_ok=True)
        _write(f"{name}.keys", keys)
        stats = [int(n.sum()), len(keys), *_count_classes(n)]
        if kind == WORD:
            _write(f"{name}.counts", n.astype("<u8"))
            return pa.Table.from_arrays(_batch([(kind, r, None, None, stats)]), schema=_TYPE)
        _write(f"{name}.counts", np.minimum(n, full).astype("<u2"))
        _write(f"{name}.large", n[n >= full].astype("<u8"))
        pair = unmix(keys)
        classes = np.stack([n, n == 1, n == 2, n > 2], axis=1).astype(np.int64)
        first, totals = added(pair >> np.uint64(32), classes)
        second, before = added(pair & np.uint64(2**32 - 1), np.ones(len(pair), np.int64))
        rows = [(kind, r, None, None, stats)]
        rows += [(*x, None) for x in _rows(FIRST, first, totals, n_lower, 32)]
        rows += [(*x, None) for x in _rows(SECOND, second, before, n_lower, 32)]
        return pa.Table.from_arrays(_batch(rows), schema=_TYPE)

    return run


def _add_lower(folder: str):
    """Add up and write one range of first or second words; pass statistics through."""
    def run(table: pa.Table) -> pa.Table:
        kind, r = table["kind"][0].as_py(), table["range"][0].as_py()
        if kind in (WORD, PAIR):
            return table.select(["kind", "stats"])
        keys, n = _gather(table, 4 if kind == FIRST else 1)
        name = f"{folder}/{kind}-{r}"
        _write(f"{name}.keys", keys)
        _write(f"{name}.counts", n.astype("<u8"))
        stats = [len(keys)] if kind == FIRST else [int(n.sum()), len(keys), *_count_classes(n),
                                                   int((n > 2).sum())]
        return pa.table({"kind": pa.array([kind], pa.int32()),
                         "stats": pa.array([stats], pa.list_(pa.int64()))})

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2, and 3 or more."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    each = [(i - (i + 1) * y * b / a) if a and b else i / 2 for i, a, b in
            ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.05), i) for i, d in enumerate(each, 1))


#: files a worker has mapped at once: a map holds a descriptor, and a model has files by the range
OPEN = 256
_maps: OrderedDict[tuple[str, str], np.ndarray] = OrderedDict()


class Model:
    """Where the arrays are, and the numbers that hold for the whole model."""

    def __init__(self, folder: str, n_ranges: int, n_lower: int, stats: dict[int, list[int]]):
        self.folder, self.n_ranges, self.n_lower = folder, n_ranges, n_lower
        self.full = FULL
        self.n, self.v = (stats.get(WORD) or [0, 0])[:2]
        pair = stats.get(PAIR) or [0] * 6
        second = stats.get(SECOND) or [0] * 7
        self.discount = np.array([0.0, *discounts(*pair[2:6])])
        self.lower = np.array([0.0, *discounts(*second[2:6])])
        self.pairs = second[0]
        spread = self.lower[1] * second[2] + self.lower[2] * second[3] + self.lower[3] * second[6]
        self.floor = (spread / self.pairs if self.pairs else 1.0) / (self.v + 1)

    def _map(self, name: str, dtype: str) -> np.ndarray:
        key = (self.folder, name)
        if key not in _maps:
            path = f"{self.folder}/{name}"
            size = os.path.getsize(path) if os.path.exists(path) else 0
            _maps[key] = np.memmap(path, dtype, "r") if size else np.empty(0, dtype)
            while len(_maps) > OPEN:  # the one not used for longest is closed
                _maps.popitem(last=False)
        _maps.move_to_end(key)
        return _maps[key]

    def find(self, kind: int, keys: np.ndarray, width: int = 1) -> np.ndarray:
        """Counts of sorted keys, 0 for keys the model does not have."""
        out = np.zeros((len(keys), width), np.int64)
        n, bits = (self.n_ranges, 64) if kind in (WORD, PAIR) else (self.n_lower, 32)
        edge = range_of(keys, n, bits)
        for r in np.flatnonzero(np.diff(edge)).tolist():
            have = self._map(f"{kind}-{r}.keys", "<u8")
            if not len(have):
                continue
            mine = keys[edge[r]:edge[r + 1]]
            at = np.minimum(np.searchsorted(have, mine), len(have) - 1)
            hit = have[at] == mine
            counts = self._map(f"{kind}-{r}.counts", "<u2" if kind == PAIR else "<u8")
            found = counts.reshape(-1, width)[at[hit]].astype(np.int64)
            full = np.flatnonzero(found[:, 0] == self.full) if kind == PAIR else ()
            if len(full):  # as many in order as the file of large counts has
                place = np.searchsorted(np.flatnonzero(counts == self.full), at[hit][full])
                found[full, 0] = self._map(f"{kind}-{r}.large", "<u8")[place]
            out[edge[r]:edge[r + 1]][hit] = found
        return out if width > 1 else out[:, 0]

    def score(self, texts: pa.Array) -> dict[str, np.ndarray]:
        words, row, pairs = tokens(texts)
        distinct, back = np.unique(words, return_inverse=True)
        known = self.find(WORD, distinct)
        base = np.log10((known + 1) / (self.n + self.v + 1))
        short = np.unique(distinct >> np.uint64(32))
        before = self.find(SECOND, short)
        one = self.floor + np.maximum(before - self.lower[np.minimum(before, 3)], 0) / max(self.pairs, 1)
        some, pair_back = np.unique(pairs, return_inverse=True)
        n = self.find(PAIR, some)
        spelled = unmix(some)
        first, of_pair = np.unique(spelled >> np.uint64(32), return_inverse=True)
        context = self.find(FIRST, first, 4)
        total = context[:, 0]
        rest = np.where(total > 0, (context[:, 1:] @ self.discount[1:]) / np.maximum(total, 1), 1.0)
        second = np.searchsorted(short, spelled & np.uint64(2**32 - 1))
        p = np.maximum(n - self.discount[np.minimum(n, 3)], 0) / np.maximum(total[of_pair], 1) \
            + rest[of_pair] * one[second]
        size = len(texts)
        return {"n_tokens": np.bincount(row, minlength=size),
                "n_known": np.bincount(row, weights=(known > 0)[back], minlength=size).astype(np.int64),
                "base_score": np.bincount(row, weights=base[back], minlength=size),
                "score": np.bincount(row, weights=np.log10(p)[pair_back], minlength=size)}


def train(rows: DataFrame) -> Model:
    """Count all whole texts of ``rows`` (a null one is empty) and write the arrays."""
    spark = rows.sparkSession
    texts = rows.select("text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_ranges = max(16, size // (6 * RANGE_KEYS))
    n_lower = max(16, n_ranges // 4)
    _, folder = mounted(spark, "word-model")
    stats = texts.mapInArrow(_counter(n_ranges), _FIELDS) \
        .groupBy("kind", "range").applyInArrow(_add_range(folder, n_lower, FULL), _FIELDS) \
        .groupBy("kind", "range").applyInArrow(_add_lower(folder), "kind int, stats array<long>") \
        .select("kind", F.posexplode("stats")).groupBy("kind", "pos").agg(F.sum("col").alias("n")) \
        .collect()
    found: dict[int, list[int]] = {}
    for r in sorted(stats, key=lambda r: (r.kind, r.pos)):
        found.setdefault(r.kind, []).append(r.n)
    return Model(folder, n_ranges, n_lower, found)


def score(docs: DataFrame, model: Model, *keep: Column) -> DataFrame:
    """Per document: the ``keep`` columns, n_tokens, n_known, train_tokens, base_score, score.

    Scores are log10 probabilities of the whole text and its end; null is empty, so its end alone.
    Rows that share a ``doc_id`` are scored each on its own; an empty table gives no rows; other
    columns are not read. Without training texts every token is unknown and has probability 1.
    """
    rows = docs.select(*keep, "text")
    *kept, _ = rows.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:len(kept)])

    def run(batches):
        for batch in batches:
            for block in blocks(batch, len(kept)):
                found = model.score(block.column(len(kept)))
                found["train_tokens"] = np.full(block.num_rows, model.n)
                names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
                yield pa.RecordBatch.from_arrays(
                    [*block.columns[:len(kept)], *[pa.array(found[c]) for c in names]],
                    names=[*kept, *names])

    return rows.mapInArrow(run, f"{fields}, n_tokens long, n_known long, train_tokens long, "
                           "base_score double, score double")
