"""Column-wise text work inside tasks: words, hashes and hash lists of a whole Arrow batch at once.

Everything works on the bytes of a batch, cut into blocks of whole texts, so memory is bounded by
``BLOCK`` bytes (``SMALL_BLOCK`` where nothing but memory depends on it) or the longest single text. Hashes are 64-bit and depend on the word alone, never on
the task; they name words and shingles, for which two different ones share a hash with a chance of
about n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK, SMALL_BLOCK = 1 << 20, 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: bytes of a word: all but white space ([\x20\x09-\x0D])
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: bytes of a word: digits, ASCII letters and everything beyond ASCII
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_BYTE = np.random.default_rng(20240607).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def blocks(batch: pa.RecordBatch, column: int, limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Runs of at most 65,000 rows whose texts have at most ``limit`` bytes together, or one row."""
    sizes = batch.column(column).cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset:sizes.offset + len(sizes) + 1]
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows, start + 65_000)
        yield batch.slice(start, stop - start)
        start = stop


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and where each begins and ends; null is empty."""
    texts = column.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if off[-1] == off[0]:
        return np.empty(0, np.uint8), np.zeros(len(off), np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[off[0]:off[-1]], off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n + n // 4, 2 * SMALL_BLOCK)
        _powers.clear()
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers.append(np.multiply.accumulate(a))
    return _powers[0][:n], _powers[1][:n]


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of every byte span, by one running sum of the whole block."""
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start]
               + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def spans(data: np.ndarray, off: np.ndarray, inside: np.ndarray):
    """Start, end and row of every maximal run of bytes ``inside`` holds; runs end with their text."""
    is_in = inside[data]
    before = np.zeros(len(data), bool)
    before[1:] = is_in[:-1]
    first = off[:-1]
    before[first[first < len(data)]] = False
    start = np.flatnonzero(is_in & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = is_in[1:]
    after[off[1:][off[1:] > 0] - 1] = False
    end = np.flatnonzero(is_in & ~after) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def word_hashes(column: pa.Array, inside: np.ndarray, lower: bool = True):
    """Hash and row of every word of the column, in order."""
    data, off = flat(column)
    if lower:
        data = LOWER[data]
    start, end, row = spans(data, off, inside)
    return span_hash(data, start, end), row


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each position on that has as many after it."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    last = len(words) - n + 1
    h = np.zeros(last, np.uint64)
    for i in range(n):
        h = mix(h + words[i:last + i] * np.uint64(2 * i + 3))
    return h


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit values as differences, each in as few bytes as the largest needs."""
    if not len(values):
        return b""
    steps = np.diff(values, prepend=np.uint64(0))
    width = max(1, -(-int(steps[1:].max()).bit_length() // 8)) if len(values) > 1 else 1
    lanes = steps[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + int(values[0]).to_bytes(8, "little") + lanes.tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    """Inverse of ``pack_sorted``."""
    if not blob:
        return np.empty(0, np.uint64)
    width, first = blob[0], np.frombuffer(blob, "<u8", 1, 1)
    lanes = np.frombuffer(blob, np.uint8, -1, 9).reshape(-1, width)
    full = np.zeros((len(lanes), 8), np.uint8)
    full[:, :width] = lanes
    return np.cumsum(np.concatenate([first, full.view("<u8").ravel()]), dtype=np.uint64)


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of every run of equal values, and the run's length."""
    if not len(sorted_values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return start, np.diff(np.append(start, len(sorted_values)))
