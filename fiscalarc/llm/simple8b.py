"""Token ids in files of 64-bit words: Simple-8b coding with per-block offsets.

A word holds a 4-bit selector and 60 bits of ids: the selector says how many ids of how many bits.
An id of more than 30 bits escapes to a word of its own. Ids come in blocks of ``BLOCK_IDS``; no
word crosses a block, and the index has each block's first word, so any block is decoded alone and
all blocks at once. A file is a row of segments; a segment is

    magic, n_docs, n_ids, n_words (4 little-endian unsigned 64-bit numbers), doc_ids (signed),
    ids per document, first word of each block (unsigned 32-bit, padded to 8 bytes), words.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import mounted, stored
from .text import blocks
from .tokens import coder

BLOCK_IDS = 128
FILE_BYTES = 16 << 20
MAGIC = int.from_bytes(b"S8B-IDS1", "little")
#: added to the size of a document without an id
NO_ID = np.uint64(1 << 63)
#: ids per word and bits per id, by selector
SELECTORS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12),
             (4, 15), (3, 20), (2, 30)]
ESCAPE = 15
_COUNT = np.array([n for n, _ in SELECTORS] + [0] * (ESCAPE - len(SELECTORS)) + [1], np.int64)
_LIMITS = np.array([1 << bits for _, bits in SELECTORS], np.uint64)


def _widened(most: np.ndarray, by: int) -> np.ndarray:
    """Maxima of windows of each row, for windows that reach ``by`` further and end with the row."""
    if not by:
        return most
    out = most.copy()
    np.maximum(out[:, :-by], most[:, by:], out=out[:, :-by])
    return out


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the first word of every block with the number of words at the end."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    n_blocks = -(-n // BLOCK_IDS)
    if not n:
        return np.empty(0, np.uint64), np.zeros(1, np.uint32)
    # per id the first selector with enough bits; per window of ids, in blocks side by side, the largest
    needs = np.zeros((n_blocks, BLOCK_IDS), np.uint8)
    needs.ravel()[:n] = np.searchsorted(_LIMITS, ids, side="right")
    most, choice = {1: needs}, np.full(needs.shape, ESCAPE, np.uint8)
    for s in reversed(range(len(SELECTORS))):  # a later, denser selector replaces an earlier one
        count = SELECTORS[s][0]
        half = 1 << (count.bit_length() - 1)
        if half not in most:
            most[half] = _widened(most[half // 2], half // 2)
        choice[_widened(most[half], count - half) <= s] = s
    choice = choice.ravel()[:n]
    step = np.minimum(_COUNT[choice], np.minimum(BLOCK_IDS - np.arange(n) % BLOCK_IDS, n - np.arange(n)))
    starts, at = [], np.arange(n_blocks) * BLOCK_IDS
    while len(at):
        starts.append(at)
        at = at + step[at]
        at = at[(at < n) & (at % BLOCK_IDS != 0)]
    start = np.sort(np.concatenate(starts))
    words = choice[start].astype(np.uint64)
    for s in np.unique(choice[start]).tolist():
        mine = np.flatnonzero(choice[start] == s)
        count, bits = SELECTORS[s] if s != ESCAPE else (1, 60)
        first, length = start[mine], step[start[mine]]
        for k in range(count):
            live = length > k
            words[mine[live]] |= ids[first[live] + k] << np.uint64(4 + k * bits)
    offsets = np.append(np.searchsorted(start, np.arange(n_blocks) * BLOCK_IDS), len(words))
    return words, offsets.astype(np.uint32)


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """Inverse of ``encode``: all blocks at once."""
    out = np.empty(n, np.uint32)
    if not n:
        return out
    selector = (words & np.uint64(15)).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(_COUNT[selector])])
    block = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets.astype(np.int64)))
    at = upto[:-1] - upto[offsets[:-1]][block] + block * BLOCK_IDS
    end = np.minimum((block + 1) * BLOCK_IDS, n)
    for s in np.unique(selector).tolist():
        mine = np.flatnonzero(selector == s)
        count, bits = SELECTORS[s] if s != ESCAPE else (1, 60)
        word, first, length = words[mine] >> np.uint64(4), at[mine], (end - at)[mine]
        mask = np.uint64((1 << bits) - 1)
        for k in range(count):
            live = length > k
            out[first[live] + k] = (word[live] >> np.uint64(k * bits)) & mask
    return out


def segment(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray, null: np.ndarray | None = None
            ) -> bytes:
    """``null`` marks the documents without an id: ``NO_ID`` is added to their sizes."""
    sizes = sizes.astype("<u8")
    if null is not None:
        sizes[null] |= NO_ID
    words, offsets = encode(ids)
    if len(offsets) % 2:
        offsets = np.append(offsets, offsets[-1])
    head = np.array([MAGIC, len(doc_ids), len(ids), len(words)], "<u8")
    return b"".join([head.tobytes(), doc_ids.astype("<i8").tobytes(), sizes.tobytes(),
                     offsets.astype("<u4").tobytes(), words.astype("<u8").tobytes()])


def segments(content: bytes):
    """(doc_ids as an Arrow array, ids per document, ids) of each segment of a file."""
    at = 0
    while at < len(content):
        magic, n_docs, n_ids, n_words = np.frombuffer(content, "<u8", 4, at).tolist()
        if magic != MAGIC:
            raise ValueError("not a file of packed token ids")
        at += 32
        docs = np.frombuffer(content, "<i8", n_docs, at)
        sizes = np.frombuffer(content, "<u8", n_docs, at + 8 * n_docs)
        null, sizes = sizes & NO_ID != 0, (sizes & ~NO_ID).astype(np.int64)
        at += 16 * n_docs
        n_off = -(-n_ids // BLOCK_IDS) + 1
        offsets = np.frombuffer(content, "<u4", n_off, at)
        at += 4 * (n_off + n_off % 2)
        yield pa.array(docs, pa.int64(), mask=null), sizes, decode(np.frombuffer(content, "<u8", n_words, at), offsets, n_ids)
        at += 8 * n_words


def write_ids(docs: DataFrame, tokenizer: str, end_id: int) -> tuple[str, DataFrame]:
    """Ids of every whole text, each ended by ``end_id``, in files in ascending ``doc_id`` order.

    Returns the folder and one row per file: part, name, n_docs, n_ids. Null text is empty; rows
    without a ``doc_id`` come first and are read back without one. Rows that share a ``doc_id`` follow
    each other, ordered by text. A file is written whole, then renamed, so a task that runs again
    only repeats it.
    """
    uri, folder = mounted(docs.sparkSession, "ids")

    def run(batches):
        from pyspark import TaskContext

        os.makedirs(folder, exist_ok=True)
        part, number = TaskContext.get().partitionId(), 0
        held, size, n_docs, n_ids = [], 0, 0, 0

        def flush():
            name = f"part-{part:06d}-{number:05d}.s8b"
            scratch = f"{folder}/.{name}.{uuid.uuid4().hex}"
            with open(scratch, "wb") as out:
                out.writelines(held)
            os.replace(scratch, f"{folder}/{name}")
            return pa.RecordBatch.from_pydict(
                {"part": [part], "name": [name], "n_docs": [n_docs], "n_ids": [n_ids]})

        for batch in batches:
            for block in blocks(batch, 1):
                ids, at = coder(tokenizer).column(block.column(1))
                rows = len(at) - 1
                with_end = np.insert(ids, at[1:], np.uint32(end_id))
                doc_id = block.column(0)
                held.append(segment(doc_id.fill_null(0).to_numpy(), np.diff(at) + 1, with_end,
                                    doc_id.is_null().to_numpy(zero_copy_only=False)))
                size, n_docs, n_ids = size + len(held[-1]), n_docs + rows, n_ids + len(with_end)
                if size >= FILE_BYTES:
                    yield flush()
                    held, size, n_docs, n_ids, number = [], 0, 0, 0, number + 1
        if held:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") \
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = ordered.mapInArrow(run, "part long, name string, n_docs long, n_ids long")
    return uri, stored(files, "ids-files")


def read_ids(spark, uri: str, files: DataFrame) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32."""
    order = Window.orderBy("part", "name").rowsBetween(Window.unboundedPreceding, -1)
    base = files.select("name", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("base"))
    fields = "name string, doc_id long, at long, n_tokens long, ids_crc32 long"
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                before = 0
                for docs, sizes, ids in segments(content.as_buffer().to_pybytes()):
                    end = np.cumsum(sizes)
                    raw, stops = ids.astype("<u4").tobytes(), (4 * end).tolist()
                    sums = [zlib.crc32(raw[a:b]) for a, b in zip([0, *stops], stops)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(docs), pa.string()), docs,
                         pa.array(before + end - sizes), pa.array(sizes), pa.array(sums, pa.int64())],
                        names=["name", "doc_id", "at", "n_tokens", "ids_crc32"])
                    before += int(end[-1]) if len(end) else 0

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(uri) \
        .select(F.element_at(F.split("path", "/"), -1).alias("name"), "content") \
        .mapInArrow(run, fields)
    return found.join(base, "name").select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
