"""Alignment of two tokenizers: which tokens of one end where tokens of the other end.

Both tokenizers encode the text with a space before it, A as given bytes, B by its own leading space.
A text is cut before spaces that follow a visible character. No token of either tokenizer holds a
space after another character, so the tokens of the parts one after the other are those of the text;
equal parts are encoded once per worker. Tokens are then byte ranges.

The merge advances one state vector over a batch of documents in lockstep: per step every document
compares the ends of its next A token and its next B token, moves the pointer that lags (both, when
the ends are equal, which emits a link and cuts a group), and documents that are through leave the
vector. Long documents enter as several lanes that begin at ends both tokenizers share, so the steps
of a batch grow with a lane and not with its longest document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored
from .text import blocks, flat, span_hash
from .tokens import _AS_TEXT, Coder

#: distinct parts whose ids a worker keeps
KEEP = 120_000
#: bytes after which a new lane may begin
LANE = 256
#: links counted at once before equal pairs are added up
BUFFER = 1 << 21


def _unicode_space_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a space beyond ASCII ends just before each place."""
    b1, b2, b3 = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))
    return ((b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))
            | (b3 == 0xE1) & (b2 == 0x9A) & (b1 == 0x80)
            | (b3 == 0xE2) & (b2 == 0x80) & ((b1 <= 0x8A) | (b1 == 0xA8) | (b1 == 0xA9) | (b1 == 0xAF))
            | (b3 == 0xE2) & (b2 == 0x81) & (b1 == 0x9F)
            | (b3 == 0xE3) & (b2 == 0x80) & (b1 == 0x80))


def _spaced(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each non-empty one after a space, and where each begins and ends."""
    data, off = flat(texts)
    size = np.diff(off)
    before = np.cumsum(size > 0)
    out = np.full(len(data) + int(before[-1]) if len(before) else 0, 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(before, size)] = data
    return out, off + np.concatenate([[0], before])


def _parts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the parts that both tokenizers encode on their own."""
    at = np.flatnonzero((data[1:] == 32) & (data[:-1] > 32) & (data[:-1] != 127)) + 1
    at = at[~_unicode_space_before(data, at)]
    cut = np.zeros(len(data), bool)
    cut[at] = True
    cut[off[:-1][np.diff(off) > 0]] = True
    start = np.flatnonzero(cut)
    return start, np.append(start[1:], len(data))


class _Bytes(Coder):
    """Tokenizer A; strings of special tokens inside a text are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        back = {c: b for b, c in _AS_TEXT.items()}
        vocabulary = self.tokenizer.get_vocab()
        self.entries = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.entries[i] = bytes(back[c] for c in token if c in back)

    def encode(self, parts: list[bytes]) -> list[list[int]]:
        return self._encode([p.decode("utf-8", "replace") for p in parts])


class _Pieces:
    """Tokenizer B, which puts a space before what it encodes."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.space = self.model.piece_to_id("▁")
        self.entries = [
            bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
            for i in range(self.model.get_piece_size()) for p in [self.model.id_to_piece(i)]]

    def encode(self, parts: list[bytes]) -> list[list[int]]:
        found = self.model.encode([p[1:].decode("utf-8", "replace") for p in parts], num_threads=1)
        # a space at the end of a text is a part, and what it would put the space before is empty
        return [[self.space] if p == b" " else f for p, f in zip(parts, found)]


class _Memory:
    """The ids that one tokenizer gave to the parts a worker has met."""

    def __init__(self, coder):
        self.coder, self.sizes = coder, np.array([len(e) for e in coder.entries], np.int64)
        self.ids, self.at = np.empty(0, np.int32), np.zeros(1, np.int64)

    def add(self, parts: list[bytes], keep: bool) -> np.ndarray:
        """Encode parts at the end; whether the bytes of each one's tokens are the part's."""
        found = self.coder.encode(parts)
        size = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter((i for f in found for i in f), np.int32, int(size.sum()))
        if not keep:
            self.ids, self.at = np.empty(0, np.int32), np.zeros(1, np.int64)
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(size)])
        self.ids = np.concatenate([self.ids, ids])
        entries = self.coder.entries
        return np.array([b"".join([entries[i] for i in f]) == p for f, p in zip(found, parts)], bool)

    def of(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts in ``slot``, one after the other, and how many each has."""
        size = self.at[slot + 1] - self.at[slot]
        upto = np.cumsum(size)
        move = np.repeat(self.at[slot] - (upto - size), size)
        return self.ids[np.arange(upto[-1] if len(upto) else 0) + move], size


class Pair:
    """Encodes columns of texts with both tokenizers."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = _Memory(_Bytes(path_a)), _Memory(_Pieces(path_b))
        self.keys, self.slot = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.fits = np.empty(0, bool)

    def column(self, texts: pa.Array):
        """Per tokenizer the ids of all texts one after the other, their ends in bytes, and where
        each text's ids begin and end; a text whose bytes the tokens do not give back has no ids."""
        data, off = _spaced(texts)
        n = len(off) - 1
        if not len(data):
            none = np.empty(0, np.int32), np.empty(0, np.int64), np.zeros(n + 1, np.int64)
            return none, none
        start, end = _parts(data, off)
        key = span_hash(data, start, end)
        fresh, where, inverse = np.unique(key, return_index=True, return_inverse=True)
        new = ~np.isin(fresh, self.keys, assume_unique=True)
        if new.any():
            keep = len(self.keys) + int(new.sum()) <= KEEP
            if not keep:
                self.keys, self.slot, self.fits = self.keys[:0], self.slot[:0], self.fits[:0]
                new = np.ones(len(fresh), bool)
            raw = data.tobytes()
            parts = [raw[s:e] for s, e in zip(start[where[new]].tolist(), end[where[new]].tolist())]
            fits = self.a.add(parts, keep) & self.b.add(parts, keep)
            keys = np.concatenate([self.keys, fresh[new]])
            slot = np.concatenate([self.slot, len(self.fits) + np.arange(len(parts))])
            self.fits = np.concatenate([self.fits, fits])
            order = np.argsort(keys, kind="stable")
            self.keys, self.slot = keys[order], slot[order]
        slot = self.slot[np.searchsorted(self.keys, fresh)][inverse]
        row = np.searchsorted(off, start, side="right") - 1
        good = np.ones(n, bool)
        good[row[~self.fits[slot]]] = False
        slot, row = slot[good[row]], row[good[row]]
        out = []
        for memory in (self.a, self.b):
            ids, size = memory.of(slot)
            per_row = np.bincount(row, weights=size, minlength=n).astype(np.int64)
            out.append((ids, np.cumsum(memory.sizes[ids]), np.concatenate([[0], np.cumsum(per_row)])))
        return out[0], out[1]


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the A and B tokens that end together, ascending.

    ``ends_a`` and ``ends_b`` are the ends of all documents' tokens in one running byte count;
    ``last`` holds the ends of the documents that have tokens.
    """
    if not len(ends_a):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    mark = ends_a[np.minimum(np.searchsorted(ends_a, np.arange(LANE, ends_a[-1], LANE)), len(ends_a) - 1)]
    shared = mark[ends_b[np.minimum(np.searchsorted(ends_b, mark), len(ends_b) - 1)] == mark]
    stop = np.unique(np.concatenate([shared, last]))
    a_stop, b_stop = (np.searchsorted(e, stop, side="right") for e in (ends_a, ends_b))
    a, b = (np.concatenate([[0], s[:-1]]) for s in (a_stop, b_stop))
    found_a, found_b = [], []
    while len(a):
        ea, eb = ends_a[a], ends_b[b]
        hit = ea == eb
        found_a.append(a[hit])
        found_b.append(b[hit])
        a, b = a + (ea <= eb), b + (eb <= ea)
        going = a < a_stop
        if not going.all():
            a, b, a_stop = a[going], b[going], a_stop[going]
    return np.sort(np.concatenate(found_a)), np.sort(np.concatenate(found_b))


_pairs: dict[tuple[str, str], Pair] = {}


def _aligned(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str):
    """Per block of (doc_id, text): the ids, the ends of the rows' ids, the places of the last ids of
    all groups, and the ends of the rows' groups."""
    if (path_a, path_b) not in _pairs:
        _pairs[path_a, path_b] = Pair(path_a, path_b)
    pair = _pairs[path_a, path_b]
    for batch in batches:
        for block in blocks(batch, 1):
            (ids_a, ends_a, off_a), (ids_b, ends_b, off_b) = pair.column(block.column(1))
            through = off_a[1:][np.diff(off_a) > 0]
            at_a, at_b = lockstep(ends_a, ends_b, ends_a[through - 1])
            yield block.column(0), ids_a, ids_b, off_a, off_b, at_a, at_b, np.searchsorted(at_a, off_a)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per row: doc_id, the ids of both tokenizers, and per group how many A and B ids end with it.

    A text that is null, empty, or not given back byte by byte by both tokenizers has empty lists.
    Rows that share a ``doc_id``, or have none, are aligned each on its own; an empty table gives no
    rows; other columns are not read.
    """
    def lists(values: np.ndarray, off: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values.astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ident, ids_a, ids_b, off_a, off_b, at_a, at_b, groups in _aligned(batches, path_a, path_b):
            n = np.diff(groups)
            yield pa.RecordBatch.from_arrays(
                [ident, lists(ids_a, off_a), lists(ids_b, off_b),
                 lists(at_a + 1 - np.repeat(off_a[:-1], n), groups),
                 lists(at_b + 1 - np.repeat(off_b[:-1], n), groups)],
                names=["doc_id", "a_ids", "b_ids", "a_upto", "b_upto"])

    return _rows(docs).mapInArrow(run, "doc_id long, a_ids array<int>, b_ids array<int>, "
                                       "a_upto array<int>, b_upto array<int>")


_digits: list[tuple[np.ndarray, np.ndarray]] = []


def _decimal(limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of all ids below ``limit``, left-aligned, and how many each has."""
    if not _digits or len(_digits[0][1]) < limit:
        width = len(str(limit))
        text = np.char.encode(np.arange(limit).astype(f"U{width}"))
        _digits[:] = [(text.view(np.uint8).reshape(limit, width), np.char.str_len(text).astype(np.int64))]
    return _digits[0]


def written(ids_a, ids_b, at_a, at_b, ends) -> tuple[np.ndarray, np.ndarray]:
    """Bytes ``a1,a2|b1;a3|b2,b3`` of all groups of a block, and where each row's begin and end.

    ``at_a`` and ``at_b`` are the places of the last ids of the groups, ``ends`` the numbers of
    groups up to the end of each row.
    """
    n_a, n_b = len(ids_a), len(ids_b)
    token = np.empty(n_a + n_b, np.int64)
    after = np.full(n_a + n_b, ord(","), np.uint8)
    size_b = np.diff(at_b, prepend=-1)
    size_a = np.diff(at_a, prepend=-1)
    place_a = np.arange(n_a) + np.repeat(at_b + 1 - size_b, size_a)
    place_b = np.arange(n_b) + np.repeat(at_a + 1, size_b)
    token[place_a], token[place_b] = ids_a, ids_b
    after[place_a[at_a]] = ord("|")
    after[place_b[at_b]] = ord(";")
    stop = np.where(ends > 0, at_a[np.maximum(ends, 1) - 1] + at_b[np.maximum(ends, 1) - 1] + 2, 0) \
        if len(at_a) else np.zeros(len(ends), np.int64)
    final = np.zeros(n_a + n_b, bool)
    final[stop[stop > 0] - 1] = True
    digits, width = _decimal(int(token.max()) + 1 if len(token) else 1)
    size = width[token] + ~final
    upto = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(upto[-1], np.uint8)
    for k in range(digits.shape[1]):
        longer = width[token] > k
        out[upto[:-1][longer] + k] = digits[token[longer], k]
    out[upto[1:][~final] - 1] = after[~final]
    return out, np.concatenate([[0], upto[np.maximum.accumulate(stop)]])


def digest(docs: DataFrame, path_a: str, path_b: str, n_b: int) -> DataFrame:
    """Per row, from the same merge as ``align``: the sizes, the hash of the written groups, and the
    links as numbers ``a * n_b + b`` of 8 bytes each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ident, ids_a, ids_b, off_a, off_b, at_a, at_b, groups in _aligned(batches, path_a, path_b):
            text, where = written(ids_a, ids_b, at_a, at_b, groups[1:])
            code = (ids_a[at_a].astype(np.int64) * n_b + ids_b[at_b]).astype("<i8").tobytes()
            raw = text.tobytes()
            yield pa.RecordBatch.from_arrays(
                [ident, pa.array(np.diff(off_a)), pa.array(np.diff(off_b)), pa.array(np.diff(groups)),
                 pa.array([hashlib.sha256(raw[s:e]).hexdigest() if e > s else ""
                           for s, e in zip(where[:-1].tolist(), where[1:].tolist())], pa.string()),
                 pa.array([code[8 * s:8 * e] for s, e in zip(groups[:-1].tolist(), groups[1:].tolist())],
                          pa.binary())],
                names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

    return _rows(docs).mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, "
                                       "groups_sha256 string, links binary")


def _links(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All links of a column, and where each row's begin and end."""
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if off[-1] == off[0]:
        return np.empty(0, np.int64), np.zeros(len(off), np.int64)
    return np.frombuffer(column.buffers()[2], "<i8", (off[-1] - off[0]) // 8, off[0]), (off - off[0]) // 8


def pair_counts(digests: DataFrame) -> DataFrame:
    """How many links of the corpus hold each pair: (pair, n).

    One token of a linked pair ends with the bytes of the other, so the two vocabularies alone bound
    the number of rows, whatever the corpus (less than ten per entry of a vocabulary, as an entry
    has only so many suffixes).
    """
    def added(pair: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        distinct, at = np.unique(pair, return_inverse=True)
        return distinct, np.bincount(at, weights=n, minlength=len(distinct)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        size = 0
        for batch in batches:
            pair = _links(batch.column(0))[0]
            pairs.append(pair)
            counts.append(np.ones(len(pair), np.int64))
            size += len(pair)
            if size > BUFFER:
                one, n = added(np.concatenate(pairs), np.concatenate(counts))
                pairs, counts, size = [one], [n], 0
        one, n = added(np.concatenate(pairs), np.concatenate(counts))
        yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(n)], names=["pair", "n"])

    return digests.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(
        F.sum("n").alias("n"))


def linked(digests: DataFrame, n_b: int) -> DataFrame:
    """Per row of ``digest``: n_links, n_best (links whose pair is the commonest of its B id) and
    count_sum (the counts of all its links' pairs) beside the sizes and the hash."""
    found = pair_counts(digests).toArrow()
    pair, n = (found.column(c).to_numpy() for c in ("pair", "n"))
    order = np.argsort(pair)
    pair, n = pair[order], n[order]
    highest = np.zeros(n_b, np.int64)
    np.maximum.at(highest, pair % n_b, n)
    best = n == highest[pair % n_b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, off = _links(batch.column(5))
            at = np.searchsorted(pair, code)
            size = np.diff(off)
            # differences of running sums: exact, as all are whole numbers
            upto = np.concatenate([[0], np.cumsum(n[at])]), np.concatenate([[0], np.cumsum(best[at])])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(size), pa.array(np.diff(upto[1][off])),
                 pa.array(np.diff(upto[0][off])), batch.column(4)],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                       "groups_sha256"])

    return digests.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, "
                                   "n_best long, count_sum long, groups_sha256 string")


def alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Texts without tokens (see ``align``) have zeros and an empty hash.
    """
    import sentencepiece

    n_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    return linked(stored(digest(docs, path_a, path_b, n_b), "alignment"), n_b)
