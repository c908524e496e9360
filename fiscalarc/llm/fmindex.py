"""Benchmark decontamination with an FM-index per shard of documents.

A shard is a block of whole documents in one task. Its words become symbols: those of the test
phrases' vocabulary in hash order, anything else breaks the sequence. Stretches too short to hold a
phrase are left out; the rest, each closed by a separator, is indexed: suffix array, its last column
in a wavelet matrix, and every ``SAMPLE``-th text position. All phrases are searched backwards at
once by rank queries; their rows are located by walking to a sampled position. Hit spans of a
document are merged. Words are compared by 64-bit hash.

Phrases are held by every task, so they are dealt in slices of at most ``SLICE_WORDS`` words by
``item_id``; with more than one, the documents are written with a number per row and read once per
slice, and the per-slice rows are joined by that number.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored
from .text import ALNUM, LOWER, blocks, flat, runs, span_hash, spans

SAMPLE = 8
SLICE_WORDS = 1_000_000


class Phrases:
    """Distinct test phrases as rows of symbols, and the items each belongs to."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        texts = pa.array([text for _, text in items], pa.large_string())
        data, off = flat(texts)
        data = LOWER[data]
        start, end, row = spans(data, off, ALNUM)
        words = span_hash(data, start, end)
        self.vocabulary = np.unique(words)
        symbol = np.searchsorted(self.vocabulary, words) + 1
        self.items = [item for item, _ in items]
        seen: dict[tuple[int, ...], set[int]] = {}
        first = np.searchsorted(row, np.arange(len(items) + 1))
        for i in range(len(items)):
            mine = symbol[first[i]:first[i + 1]].tolist()
            size = min(window, len(mine))
            for at in range(len(mine) - size + 1 if size else 0):
                seen.setdefault(tuple(mine[at:at + size]), set()).add(i)
        self.owners = [sorted(v) for v in seen.values()]
        self.length = np.array([len(p) for p in seen], np.int64)
        self.longest = int(self.length.max(initial=0))
        self.shortest = int(self.length.min(initial=window))
        self.symbols = np.zeros((len(seen), self.longest), np.int64)
        for i, phrase in enumerate(seen):
            self.symbols[i, :len(phrase)] = phrase

    def symbol_of(self, words: np.ndarray) -> np.ndarray:
        """Symbol of every word; 0 for words no phrase has."""
        if not len(self.vocabulary):
            return np.zeros(len(words), np.int64)
        near = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[near] == words, near + 1, 0)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes by doubling; only suffixes not yet told apart are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    start, size = runs(text[order])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(start, size)
    width = 1
    while True:
        open_rows = np.flatnonzero(np.repeat(size > 1, size))
        if not len(open_rows):
            return order
        rows = order[open_rows]
        behind = rows + width
        second = np.where(behind < n, rank[np.minimum(behind, n - 1)], -1)
        group = rank[rows]
        rows = rows[np.lexsort((second, group))]
        order[open_rows] = rows
        behind = rows + width
        second = np.where(behind < n, rank[np.minimum(behind, n - 1)], -1)
        group = rank[rows]
        changed = np.ones(n, bool)
        changed[open_rows[1:]] = (group[1:] != group[:-1]) | (second[1:] != second[:-1]) | (
            np.diff(open_rows) != 1)
        start = np.flatnonzero(changed)
        size = np.diff(np.append(start, n))
        rank[order] = np.repeat(start, size)
        width *= 2


class WaveletMatrix:
    """Rank of any symbol at any position, one bit of the symbol at a time."""

    def __init__(self, text: np.ndarray):
        self.bits = max(1, int(text.max(initial=0)).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in reversed(range(self.bits)):
            bit = (text >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(len(text) - int(self.ones[-1][-1]))
            text = np.concatenate([text[bit == 0], text[bit == 1]])

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        low, high = np.zeros_like(position), position
        for i, level in enumerate(reversed(range(self.bits))):
            ones, bit = self.ones[i], ((symbol >> level) & 1).astype(bool)
            low_ones, high_ones = ones[low], ones[high]
            low = np.where(bit, self.zeros[i] + low_ones, low - low_ones)
            high = np.where(bit, self.zeros[i] + high_ones, high - high_ones)
        return high - low


class FMIndex:
    """Backward search and location over one sequence of symbols (0 separates).

    Inside, symbols are one larger and a single 0 ends the sequence, so that walking back from the
    first position meets the only row of its kind.
    """

    def __init__(self, text: np.ndarray):
        text = np.append(text + 1, 0)
        order = suffix_array(text)
        self.last = text[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text))])
        self.wavelet = WaveletMatrix(self.last)
        self.sampled = order % SAMPLE == 0
        self.slot = np.cumsum(self.sampled) - 1
        self.position = order[self.sampled]
        self.n = len(text)

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        known = symbol < len(self.before) - 1
        return self.before[np.where(known, symbol, 0)] + np.where(
            known, self.wavelet.rank(np.where(known, symbol, 0), row), 0)

    def search(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, text position) of every occurrence."""
        low = np.zeros(len(phrases.length), np.int64)
        high = np.full(len(phrases.length), self.n)
        live = np.arange(len(phrases.length))
        for back in range(phrases.longest):
            live = live[(high[live] > low[live])]
            go = live[phrases.length[live] > back]
            if not len(go):
                break
            symbol = phrases.symbols[go, phrases.length[go] - 1 - back] + 1
            inside = symbol < len(self.before) - 1
            high[go[~inside]] = low[go[~inside]]
            go, symbol = go[inside], symbol[inside]
            low[go], high[go] = self.step(symbol, low[go]), self.step(symbol, high[go])
        size = np.maximum(high - low, 0)
        phrase = np.repeat(np.arange(len(size)), size)
        row = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + low[phrase]
        return phrase, self.locate(row)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text position of each row: walk back to a sampled one, count the steps."""
        found, walked = np.empty(len(row), np.int64), 0
        left = np.arange(len(row))
        while len(left):
            here = self.sampled[row]
            found[left[here]] = self.position[self.slot[row[here]]] + walked
            left, row = left[~here], row[~here]
            row = self.step(self.last[row], row)
            walked += 1
        return found


def scan(texts: pa.Array, phrases: Phrases):
    """Per text: number of words, word spans hit (text, from, to; merged) and (text, item) pairs."""
    data, off = flat(texts)
    data = LOWER[data]
    start, end, row = spans(data, off, ALNUM)
    n_texts = len(off) - 1
    n_words = np.bincount(row, minlength=n_texts)
    nothing = np.empty((0, 3), np.int64), np.empty((0, 2), np.int64), (start, end, row)
    if not len(phrases.length) or not len(start):
        return n_words, *nothing
    symbol = phrases.symbol_of(span_hash(data, start, end))
    known = np.flatnonzero(symbol)
    new = np.ones(len(known), bool)
    new[1:] = (np.diff(known) > 1) | (row[known[1:]] != row[known[:-1]])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(known)))
    keep = np.repeat(size >= phrases.shortest, size)
    known, new = known[keep], new[keep]
    if not len(known):
        return n_words, *nothing
    place = np.arange(len(known)) + np.cumsum(new)
    text = np.zeros(place[-1] + 2, np.int64)
    text[place] = symbol[known]
    word_at = np.zeros(len(text), np.int64)
    word_at[place] = known
    phrase, position = FMIndex(text).search(phrases)
    if not len(phrase):
        return n_words, *nothing
    low = word_at[position]
    high = low + phrases.length[phrase]
    order = np.lexsort((high, low))
    low, high, phrase = low[order], high[order], phrase[order]
    reach = np.maximum.accumulate(high)
    apart = np.ones(len(low), bool)
    apart[1:] = (low[1:] > reach[:-1]) | (row[low[1:]] != row[low[:-1]])
    begin = np.flatnonzero(apart)
    spans_hit = np.stack([row[low[begin]], low[begin],
                          reach[np.append(begin[1:], len(low)) - 1]], axis=1)
    pairs = {(int(t), i) for t, p in set(zip(row[low].tolist(), phrase.tolist()))
             for i in phrases.owners[p]}
    return n_words, spans_hit, np.array(sorted(pairs), np.int64).reshape(-1, 2), (start, end, row)


def _slices(benchmark: DataFrame, window: int):
    """The number of slices, and the test items, at most about ``SLICE_WORDS`` words at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter(
        F.col("item_id").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + total // (6 * SLICE_WORDS)
    parts = (items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i) for i in range(n))
    return n, (Phrases([(r.item_id, r.text) for r in mine.collect()], window) for mine in parts)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    A window is ``window`` consecutive words of an item, or the whole of a shorter one; ``n_hit``
    counts document words inside any occurrence of any window; ``spans`` are the merged runs of hit
    words (first word, word behind the last). A null text or item text has no words; an item without
    an id is left out; rows that share a ``doc_id`` are scanned each on its own; an empty benchmark
    hits nothing. Other columns are not read.
    """
    fields = ("row long, doc_id long, n_words long, n_hit long, items array<string>, "
              "spans array<struct<first:long,last:long>>")
    n, slices = _slices(benchmark, window)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (
        F.monotonically_increasing_id() if n > 1 else F.lit(0).cast("long")).alias("row"))
    if n > 1:  # the number of a row must be the same in every slice
        base = stored(base, "numbered")
    parts = []
    for phrases in slices:
        def run(batches, phrases=phrases):
            for batch in batches:
                for block in blocks(batch, 1):
                    n_words, hit, pairs, (_, _, row) = scan(block.column(1), phrases)
                    first = np.searchsorted(row, np.arange(len(n_words)))
                    n_hit = np.bincount(hit[:, 0], weights=hit[:, 2] - hit[:, 1],
                                        minlength=len(n_words)).astype(np.int64)
                    items = [[] for _ in n_words]
                    for t, i in pairs.tolist():
                        items[t].append(phrases.items[i])
                    merged = [[] for _ in n_words]
                    for t, a, b in hit.tolist():
                        merged[t].append({"first": a - int(first[t]), "last": b - int(first[t])})
                    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
                    yield pa.RecordBatch.from_arrays(
                        [block.column(2), block.column(0), pa.array(n_words), pa.array(n_hit),
                         pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())),
                         pa.array(merged, kind)],
                        names=["row", "doc_id", "n_words", "n_hit", "items", "spans"])
        parts.append(base.mapInArrow(run, fields))
    if len(parts) == 1:
        found = parts[0]
    else:
        found = _merged(parts)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "spans")


def _merged(parts: list[DataFrame]) -> DataFrame:
    """One row per row of the documents from the rows of all slices."""
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    whole = stored(rows, "hits").groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    grow = F.aggregate(
        "s", F.expr("cast(array() as array<struct<first:long,last:long>>)"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["last"] >= x["first"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
                F.element_at(done, -1)["first"].alias("first"),
                F.greatest(F.element_at(done, -1)["last"], x["last"]).alias("last")))))
        .otherwise(F.concat(done, F.array(x))))
    merged = whole.withColumn("spans", grow)
    return merged.select("doc_id", "n_words", F.aggregate(
        "spans", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"]).alias("n_hit"),
        "items", "spans")
