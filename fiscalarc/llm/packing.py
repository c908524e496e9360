"""Packing of documents into windows: best-fit decreasing over the lengths of the whole corpus.

Documents longer than a window are first cut into full windows and a rest. Best-fit decreasing only
looks at lengths, and windows with the same room are alike. So the plan is made on the counts of the
lengths (``window`` numbers, whatever the corpus size): open windows are kept as classes (same
pieces, same room), a segment tree over the remaining room finds the tightest class that still takes
a length, and all pieces of a length move together. The plan says, for ranges of the n-th piece of a
length, which window and offset it gets; Spark numbers the pieces of a length and looks that up.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored
from .text import blocks
from .tokens import coder


class Room:
    """Segment tree over remaining room 0..size: which rooms have an open window."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.any = [False] * (2 * self.leaves)

    def set(self, room: int, value: bool) -> None:
        i = self.leaves + room
        self.any[i] = value
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """Smallest open room of at least ``least``."""
        i = self.leaves + least
        if self.any[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                break
            i //= 2
        else:
            return None
        while i < self.leaves:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.leaves


def plan(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first, count, sequence, offset): pieces ``first``.. of the length go to sequences
    ``sequence``.. at ``offset``, one each. Best-fit decreasing, all pieces of a length together."""
    tree, open_by_room = Room(window), {}
    rows, n_sequences = [], 0
    for length in sorted((k for k, v in counts.items() if v and k), reverse=True):
        placed, total = 0, counts[length]
        while placed < total:
            room = tree.tightest(length)
            new = room is None
            room = window if new else room
            # a window that takes one is now the tightest and takes all that fit
            each = min(room // length, total - placed)
            windows = (total - placed) // each
            if new:
                first, n_sequences = n_sequences, n_sequences + windows
            else:
                first, n = open_by_room[room].pop()
                windows = min(windows, n)
                if windows < n:
                    open_by_room[room].append((first + windows, n - windows))
                if not open_by_room[room]:
                    tree.set(room, False)
            for k in range(each):
                rows.append((length, placed, windows, first, window - room + k * length))
                placed += windows
            left = room - each * length
            if left:
                open_by_room.setdefault(left, []).append((first, windows))
                tree.set(left, True)
    return rows


def pieces(docs: DataFrame, tokenizer: str, end_id: int, window: int) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, and where it was made."""
    fields = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, part int, nth long"

    def run(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for batch in batches:
            for block in blocks(batch, 1):
                ids, at = coder(tokenizer).column(block.column(1))
                raw = np.insert(ids, at[1:], np.uint32(end_id)).astype("<u4").tobytes()
                at = at + np.arange(len(at))
                size = np.diff(at)
                n = -(-size // window)
                row = np.repeat(np.arange(len(size)), n)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * window
                length = np.minimum(window, size[row] - start)
                where = (4 * (at[row] + start)).tolist()
                crc = [zlib.crc32(raw[a:a + 4 * b]) for a, b in zip(where, length.tolist())]
                order = np.argsort(length, kind="stable")
                sizes, first, many = np.unique(length[order], return_index=True, return_counts=True)
                nth = np.empty(len(length), np.int64)
                nth[order] = np.arange(len(length)) - np.repeat(first, many)
                nth += seen[length]
                seen[sizes] += many
                yield pa.RecordBatch.from_arrays(
                    [block.column(0).take(pa.array(row)), pa.array(start), pa.array(length, pa.int32()),
                     pa.array(crc, pa.int64()), pa.array(size[row]),
                     pa.array(np.full(len(row), part, np.int32)), pa.array(nth)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, fields)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, window: int = 1024) -> DataFrame:
    """Every document's ids, then ``end_id``, in windows of at most ``window`` ids, little padding.

    Null text is empty: its document is ``end_id`` alone. Rows that share a ``doc_id`` are packed
    each on its own; an empty table gives no rows. Other columns are not read.

    Returns per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    spark = docs.sparkSession
    made = stored(pieces(docs, tokenizer, end_id, window), "pieces")
    per_part = made.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = stored(per_part.select("length", "part", "n", F.coalesce(
        F.sum("n").over(before), F.lit(0)).alias("base")), "piece-bases")
    # at most ``window`` rows, whatever the corpus
    counts = {r.length: r.n for r in base.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placed = spark.createDataFrame(
        plan(counts, window), "length int, first long, many long, sequence long, offset long")
    numbered = made.join(base.select("length", "part", "base"), ["length", "part"]).withColumn(
        "rank", F.col("base") + F.col("nth"))
    p = F.broadcast(placed.withColumnRenamed("length", "of"))
    return numbered.join(p, (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("first"))
                         & (F.col("rank") < F.col("first") + F.col("many"))).select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")
