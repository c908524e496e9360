"""Token ids of whole texts with the tokenizers library, each distinct word encoded once per worker.

A text is cut before single spaces, and around single line ends, that stand between two visible
bytes, and before marks that follow an ASCII letter or digit: the byte-level pre-tokenizer always begins a
new piece there, so the ids of the pieces one after the other are the ids of the text. Pieces repeat; a worker keeps the ids of those it has met, up to ``KEEP`` of them.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa

from .text import flat, span_hash

KEEP = 600_000
#: how the byte-level pre-tokenizer writes bytes: visible ones as they are, the rest from 256 on
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_AS_TEXT = {b: chr(b) for b in _SHOWN} | {
    b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}

#: marks that one after the other form one piece
_MARKS = ".,!?*%&$#|<>;:"
_ENDS = np.zeros(256, bool)
_ENDS[48:58] = _ENDS[65:91] = _ENDS[97:123] = True

_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """The worker's coder for a tokenizer file."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


class Coder:
    """Encodes columns of texts; remembers pieces as sorted hashes and flat ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._marks: dict[str, list[int]] = {}
        self._plain = type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel"
        self._mark = np.zeros(256, bool)
        self._mark[[ord(c) for c in _MARKS]] = True
        for token in self.tokenizer.get_added_tokens_decoder().values():  # such a token is one piece
            self._mark[list(token.content.encode())] = False
        self._forget()

    def _forget(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.at = np.empty(0, np.int64)
        self.size = np.empty(0, np.int32)
        self.ids = np.empty(0, np.uint32)

    def _encode(self, pieces: list[str]) -> list[list[int]]:
        """Ids per piece: a word, with or without marks behind it, goes straight to the model."""
        out: list[list[int] | None] = [None] * len(pieces)
        tokenize, rest = self.tokenizer.model.tokenize, []
        for i, piece in enumerate(pieces):
            word = piece.rstrip(_MARKS)
            lead = word[:1] == " "
            bare = word[1:] if lead else word
            if self._plain and bare.isalpha():
                shown = bare if bare.isascii() else "".join([_AS_TEXT[b] for b in bare.encode()])
                ids = [t.id for t in tokenize(_AS_TEXT[32] + shown if lead else shown)]
                if len(word) < len(piece):
                    marks = piece[len(word):]
                    if marks not in self._marks:
                        self._marks[marks] = [t.id for t in tokenize(marks)]
                    ids += self._marks[marks]
                out[i] = ids
            else:
                rest.append(i)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast(
                [pieces[i] for i in rest], add_special_tokens=False)):
            out[i] = e.ids
        return out

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin and end."""
        data, off = flat(texts)
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(off), np.int64)
        solid = (data > 32) & (data != 127) & (data != 0xC2) & (data != 0xE1) & (data != 0xE2) \
            & (data != 0xE3) & (data != 0x85) & (data != 0xA0)
        cut = np.zeros(len(data), bool)
        between = solid[:-2] & solid[2:]
        line = (data[1:-1] == 10) & between
        cut[1:-1] = line | (data[1:-1] == 32) & between
        cut[2:] |= line
        if self._plain:  # marks never share a piece with the ASCII letter or digit before them
            cut[1:] |= self._mark[data[1:]] & _ENDS[data[:-1]]
        first = off[:-1][np.diff(off) > 0]
        cut[first] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))
        key = span_hash(data, start, end)
        fresh, where, inverse = np.unique(key, return_index=True, return_inverse=True)
        if len(self.keys):
            near = np.minimum(np.searchsorted(self.keys, fresh), len(self.keys) - 1)
            new = self.keys[near] != fresh
        else:
            new = np.ones(len(fresh), bool)
        if new.any():
            if len(self.keys) + int(new.sum()) > KEEP:
                self._forget()
                new = np.ones(len(fresh), bool)
            raw = data.tobytes()
            ids = self._encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(
                start[where[new]].tolist(), end[where[new]].tolist())])
            size = np.fromiter(map(len, ids), np.int32, len(ids))
            more = np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))
            keys = np.concatenate([self.keys, fresh[new]])
            order = np.argsort(keys, kind="stable")
            self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(size) - size])[order]
            self.size = np.concatenate([self.size, size])[order]
            self.keys, self.ids = keys[order], np.concatenate([self.ids, more])
        slot = np.searchsorted(self.keys, fresh)[inverse]
        size = self.size[slot].astype(np.int64)
        upto = np.cumsum(size)
        move = np.repeat(self.at[slot] - (upto - size), size)
        ids = self.ids[np.arange(upto[-1]) + move]
        row = np.searchsorted(off, start, side="right") - 1
        per_row = np.bincount(row, weights=size, minlength=len(off) - 1).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(per_row)])
