"""Exact Jaccard join of shingle sets, size-aware: heavy and light sets by their own routes.

1. Texts with the same set become one class; its smallest ``doc_id`` stands for it.
2. A set that links with another one lacks at most a quarter of its shingles there. So of its
   shingles with a small hash (share ``THETA``) all but that many occur in a second document. Blocks
   of documents send these hashes, sorted and packed, to hash ranges and learn how many are shared;
   most documents have too few and are done. No hash is sent twice by a block, however common.
3. The shingles of the rest are ordered by frequency. Light sets (up to the boundary size) enumerate
   the pairs of the first ``slack + 2`` shingles: two linked ones share such a pair. Heavy sets scan
   the inverted lists of their first ``slack + 1`` shingles, in which light sets near the boundary
   stand too. The boundary is the size at which enumerating costs as much as scanning, summed over
   all sets. Lists with the same members count once.
4. Within a list, bitmaps (one parity bit per hash) bound the overlap from above; what remains is
   checked on the whole sets. A list first sends only the edges of a spanning forest, likeliest
   first; after their links have merged, only pairs between different components are left to send.
   So groups of near copies do not expand into all pairs, and no link between components is lost.

Shingles are compared by 64-bit hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import lookup, stored
from .text import (
    SMALL_BLOCK,
    SPACED,
    blocks,
    gram_hashes,
    pack_sorted,
    runs,
    unpack_sorted,
    word_hashes,
)

SHINGLE = 5
#: links have 100 * intersection >= PERCENT * union
PERCENT = 75
THETA = 0.4
RANGE_SHINGLES = 2_000_000
#: sending a member to a list costs as much as scanning so many members of lists
SEND = 200
LIST_BLOCK = 2048
#: new pairs that a task holds before it thins them out
EDGES = 1 << 16
TASK_ROWS = 4_000


def slack(n):
    """How many shingles of a set of ``n`` a linked set may lack."""
    return n - (PERCENT * n + 99) // 100


def sets_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct shingle, ascending by both."""
    words, row = word_hashes(texts, SPACED)
    counts = np.bincount(row, minlength=len(texts))
    grams = gram_hashes(words, SHINGLE)
    inside = row[:len(grams)] == row[SHINGLE - 1:] if len(grams) else np.empty(0, bool)
    rows, hashes = [row[:len(grams)][inside]], [grams[inside]]
    for n in range(1, SHINGLE):  # a shorter text is one shingle
        first = (np.cumsum(counts) - counts)[counts == n]
        short = gram_hashes(words, n)
        rows.append(np.flatnonzero(counts == n))
        hashes.append(short[first] + np.uint64(n))
    rows, hashes = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]


def _marks(batches):
    for batch in batches:
        for block in blocks(batch, 1, SMALL_BLOCK):
            row, shingle = sets_of(block.column(1))
            first = np.searchsorted(row, np.arange(block.num_rows + 1)).tolist()
            raw = shingle.astype("<u8").tobytes()
            keys = [hashlib.blake2b(raw[8 * a:8 * b], digest_size=16).digest()
                    for a, b in zip(first, first[1:])]
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.array(np.diff(first)), pa.array(keys, pa.binary())],
                names=["doc_id", "n", "key"])


def _sketches(n_ranges: int):
    width = int(THETA * 2**48) // n_ranges + 1

    def run(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for block in blocks(batch, 1):
                row, shingle = sets_of(block.column(1))
                n = np.bincount(row, minlength=block.num_rows)
                short = shingle >> np.uint64(16)
                low = short < np.uint64(int(THETA * 2**48))
                row, short = row[low], short[low]
                a = np.bincount(row, minlength=block.num_rows)
                order = np.argsort(short, kind="stable")
                row, short = row[order], short[order]
                start, size = runs(short)
                local = np.repeat(size > 1, size)
                met = np.bincount(row[local], minlength=block.num_rows)
                owner = np.where(size > 1, 65535, row[start]) if len(start) else start
                sent = short[start]
                edge = np.searchsorted(sent, np.arange(n_ranges + 1, dtype=np.uint64) * np.uint64(width))
                ranges = np.flatnonzero(np.diff(edge)).tolist()
                docs = pa.table({"doc_id": block.column(0), "need": a - slack(n) - met,
                                 "n": n}).filter(pa.array(n > 0))
                rows = pa.array(np.flatnonzero(n > 0).astype("<u2"))
                yield pa.RecordBatch.from_arrays(
                    # the documents of a block need no range: they pass in a group of their own
                    [pa.array([*ranges, *[n_ranges + chunk] * len(rows)], pa.int64()),
                     pa.array([chunk] * (len(ranges) + len(rows)), pa.int64()),
                     pa.array([pack_sorted(sent[edge[r]:edge[r + 1]]) for r in ranges]
                              + [None] * len(rows), pa.binary()),
                     pa.array([owner[edge[r]:edge[r + 1]].astype("<u2").tobytes() for r in ranges]
                              + [int(x).to_bytes(2, "little") for x in rows.to_pylist()], pa.binary()),
                     pa.concat_arrays([pa.nulls(len(ranges), pa.int64()),
                                       docs["doc_id"].combine_chunks().cast(pa.int64())]),
                     pa.array([None] * len(ranges) + docs["need"].to_pylist(), pa.int64()),
                     ], names=["range", "chunk", "hashes", "owner", "doc_id", "need"])
                chunk += 1

    return run


def _shared(table: pa.Table) -> pa.Table:
    """Of one hash range: per block, the rows whose hashes another block has as well."""
    plain = table.filter(pc.is_null(table["hashes"]))
    coded = table.filter(pc.is_valid(table["hashes"]))
    parts = [unpack_sorted(x.as_py()) for x in coded["hashes"]]
    owners = [np.frombuffer(x.as_py(), "<u2") for x in coded["owner"]]
    out = []
    if parts:
        source = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        every, owner = np.concatenate(parts), np.concatenate(owners)
        order = np.argsort(every, kind="stable")
        start, size = runs(every[order])
        hit = order[np.repeat(size > 1, size)]
        hit = np.sort(hit[owner[hit] != 65535])
        first = np.searchsorted(source[hit], np.arange(len(parts) + 1))
        out = [owner[hit[a:b]].tobytes() for a, b in zip(first, first[1:])]
    found = pa.table({"chunk": coded["chunk"], "owner": pa.array(out, pa.binary()),
                      "doc_id": pa.nulls(len(coded), pa.int64()),
                      "need": pa.nulls(len(coded), pa.int64())}).filter(
        pa.array([len(x) > 0 for x in out], pa.bool_()))
    return pa.concat_tables([found, plain.select(["chunk", "owner", "doc_id", "need"])])


def _enough(table: pa.Table) -> pa.Table:
    """Of one block: the documents that share as many hashes as a link needs."""
    is_doc = pc.is_valid(table["need"])
    hits = table.filter(pc.invert(is_doc))["owner"].to_pylist()
    docs = table.filter(is_doc)
    count = np.bincount(np.frombuffer(b"".join(hits), "<u2"), minlength=65536)
    row = np.frombuffer(b"".join(docs["owner"].to_pylist()), "<u2")
    keep = count[row] >= docs["need"].to_numpy()
    return pa.table({"doc_id": docs["doc_id"]}).filter(pa.array(keep))


def _whole_sets(batches):
    for batch in batches:
        for block in blocks(batch, 1, SMALL_BLOCK):
            row, shingle = sets_of(block.column(1))
            first = np.searchsorted(row, np.arange(block.num_rows + 1))
            maps = []
            for a, b in zip(first, first[1:]):
                bits = 1 << max(6, int(2 * (b - a)).bit_length())
                odd = np.bincount((shingle[a:b] % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
                maps.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.array(np.diff(first)),
                 pa.ListArray.from_arrays(pa.array(first.astype(np.int32)),
                                          pa.array(shingle.view(np.int64))),
                 pa.array(maps, pa.binary())], names=["doc", "n", "shingles", "bits"])


def _boundary(ordered: DataFrame) -> int:
    """The size up to which sets are light: least cost over all sets, by classes of size."""
    k, one = F.size("light").cast("long"), F.size("heavy").cast("long")
    classes = ordered.groupBy(F.floor(8 * F.log2("n")).alias("c")).agg(
        F.max("n").alias("n"), F.sum(SEND * k * (k - 1) / 2).alias("pairs"),
        F.sum(SEND * one + F.aggregate("heavy", F.lit(0).cast("long"), lambda a, x: a + x["f"]))
        .alias("scan")) \
        .orderBy("c").collect()
    best, cost = 0, sum(r.scan for r in classes)
    least = cost
    for r in classes:
        cost += r.pairs - r.scan
        if cost < least:
            best, least = r.n, cost
    return best


def _lists(sets: DataFrame) -> DataFrame:
    """(list, doc): members of the lists through which linked sets meet, each list once."""
    flat = sets.select("doc", "n", F.explode("shingles").alias("shingle"))
    common = flat.groupBy("shingle").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    room = F.expr(slack_sql("n")) - F.col("n") + F.size("all")
    ordered = flat.join(common, "shingle").groupBy("doc", "n").agg(
        F.sort_array(F.collect_list(F.struct("f", "shingle"))).alias("all")).select(
        "doc", "n", F.slice("all", 1, F.greatest(room + 1, F.lit(0))).alias("heavy"),
        F.slice("all", 1, F.greatest(room + 2, F.lit(0))).alias("light")).filter(F.size("light") > 0)
    ordered = stored(ordered, "prefixes")
    x = _boundary(ordered)
    pairs = F.flatten(F.transform("light", lambda a, i: F.transform(
        F.filter("light", lambda b, j: j > i), lambda b: F.xxhash64(a["shingle"], b["shingle"]))))
    light = ordered.filter(F.col("n") <= x).select("doc", F.explode(pairs).alias("list"),
                                                   F.lit(False).alias("heavy"))
    heavy = ordered.filter(F.col("n") > PERCENT * x / 100 - 1).select(
        "doc", F.explode("heavy.shingle").alias("list"), (F.col("n") > x).alias("heavy"))
    posts = light.withColumn("kind", F.lit(0)).unionByName(heavy.withColumn("kind", F.lit(1)))
    sums = posts.groupBy("kind", "list").agg(
        F.count(F.lit(1)).alias("members"), F.max("heavy").alias("heavy"),
        F.sum(F.xxhash64("doc").cast("decimal(38,0)")).alias("who"))
    kept = sums.filter((F.col("members") > 1) & (F.col("heavy") | (F.col("kind") == 0))).groupBy(
        "members", "who").agg(F.min(F.struct("kind", "list")).alias("l")).select("l.*", "members")
    return posts.select("kind", "list", "doc").join(kept, ["kind", "list"])


def slack_sql(n: str) -> str:
    return f"({n} - ({PERCENT} * {n} + 99) div 100)"


def _least_forest(comp: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Of ``edges`` (member, member, distance) a spanning forest of the components, least distance
    first and of equal ones the first."""
    edges = edges[np.argsort(edges[:, 2], kind="stable")]
    parent = list(range(len(comp)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept, most = [], int(comp.max())
    for k, (a, b) in enumerate(zip(comp[edges[:, 0]].tolist(), comp[edges[:, 1]].tolist())):
        a, b = root(a), root(b)
        if a != b:
            parent[a] = b
            kept.append(k)
            if len(kept) == most:
                break
    return edges[kept]


def _near(table: pa.Table, forest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one list, between components, whose bitmaps do not rule a link out.

    For the forest, only about ``EDGES`` pairs are held at once: an edge that the forest of some of
    the pairs leaves out is in no forest of more of them.
    """
    doc, n = table["doc"].to_numpy(), table["n"].to_numpy()
    comp, block = table["component"].to_numpy(), table["block"].to_numpy()
    if (comp == comp[0]).all():
        return doc[:0], doc[:0]
    order = np.argsort(n, kind="stable")
    doc, n, comp, block = doc[order], n[order], comp[order], block[order]
    comp = np.unique(comp, return_inverse=True)[1]
    raw = table["bits"].to_pylist()
    maps = [np.frombuffer(raw[i], "<u8") for i in order.tolist()]
    width = np.array([len(m) for m in maps])
    stacks = {w: np.stack([maps[i] for i in np.flatnonzero(width == w)]) for w in np.unique(width).tolist()}
    for w in sorted(stacks)[1:]:  # also folded to the next smaller width
        stacks[-w] = stacks[w][:, :w // 2] ^ stacks[w][:, w // 2:]
    begin = {w: int(np.flatnonzero(width == w)[0]) for w in stacks if w > 0}
    crosses = (block.min() != block.max())
    found, held, worst = [np.empty((0, 3), np.int32)], 0, None
    for i in range(len(doc)):
        stop = int(np.searchsorted(n, n[i] * 100 // PERCENT, side="right"))
        for w in (int(width[i]), 2 * int(width[i])):
            if w not in begin:
                continue
            a = max(begin[w], i + 1)
            b = min(begin[w] + len(stacks[w]), stop)
            if a >= b:
                continue
            rows = stacks[w if w == width[i] else -w][a - begin[w]:b - begin[w]]
            apart = np.bitwise_count(rows ^ maps[i]).sum(1, dtype=np.int64)
            total = n[i] + n[a:b]
            need = -(-PERCENT * total // (100 + PERCENT))
            good = (apart <= total - 2 * need) & (comp[a:b] != comp[i])
            if crosses:
                good &= block[a:b] != block[i]
            if worst is not None:  # all are connected: only a shorter edge still changes the forest
                good &= apart < worst
            j = np.flatnonzero(good)
            if not len(j):
                continue
            found.append(np.stack([np.full(len(j), i), j + a, apart[j]], axis=1).astype(np.int32))
            held += len(j)
        if forest and held > EDGES:
            found, held = [_least_forest(comp, np.concatenate(found))], 0
            if len(found[0]) == comp.max():
                worst = int(found[0][-1, 2])
    pairs = np.concatenate(found)
    if forest:
        pairs = _least_forest(comp, pairs)
    a, b = doc[pairs[:, 0]], doc[pairs[:, 1]]
    return np.minimum(a, b), np.maximum(a, b)


def _distinct(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs once, in order."""
    a, b = (np.concatenate([np.empty(0, np.int64), *side]) for side in (zip(*pairs) if pairs else ((), ())))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _candidates(members: DataFrame, forest: bool) -> DataFrame:
    """Distinct pairs (a, b) to check. ``members``: kind, list, members, doc, n, bits, component.

    A long list is dealt in blocks: pairs of blocks meet in tasks of their own, in the forest round
    each block only itself and the first one.
    """
    n_blocks = F.ceil(F.col("members") / LIST_BLOCK).cast("int")
    block = F.pmod(F.xxhash64("doc"), n_blocks).cast("int")
    placed = members.withColumn("blocks", n_blocks).withColumn("block", block)
    partner = F.when(F.col("blocks") == 1, F.array(F.lit(0)))
    if forest:
        partner = partner.when(F.col("block") > 0, F.array_distinct(F.array(F.lit(0), F.col("block"))))
    partner = partner.otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = placed.withColumn("other", F.explode(partner)).select(
        "kind", "list", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"),
        "doc", "n", "bits", "component", "block")
    tasks = max(1, members.count() // TASK_ROWS)
    keyed = placed.withColumn("task", F.pmod(F.xxhash64("kind", "list", "x", "y"), F.lit(tasks)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("kind", "list", "x", "y")])
        keys = [table[c].to_numpy() for c in ("kind", "list", "x", "y")]
        new = np.ones(len(table), bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        edge = np.append(np.flatnonzero(new), len(table))
        pairs, held = [], 0
        for a, b in zip(edge, edge[1:]):
            if b - a > 1:
                pairs.append(_near(table.slice(a, b - a).combine_chunks(), forest))
                held += len(pairs[-1][0])
            if held > max(EDGES, len(pairs[0][0])):  # the same pairs meet in many lists
                pairs, held = [_distinct(pairs)], 0
        a, b = _distinct(pairs)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return keyed.groupBy("task").applyInArrow(run, "a long, b long").distinct()


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose whole sets are alike enough."""
    def run(batches):
        for batch in batches:
            keep = []
            left, right = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                x, y = left[i].values.to_numpy(), right[i].values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)],
                                             names=["a", "b"])

    one = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("left"))
    two = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("right"))
    with_left = one.join(lookup(pairs), "a")
    return with_left.join(two, "b").select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def join(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, links): every document's class and component, and links between classes.

    documents: doc_id, n_shingles, class_id (smallest doc_id with the same set), component_id
    (smallest doc_id reachable by links). links: (a, b), class ids; they connect every component,
    not all links within one are listed. Null texts and texts without words have an empty set and
    are alone. Rows that share a ``doc_id`` are one document with the links of all of them; rows
    without one are left out. An empty table gives no rows; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    marks = stored(docs.mapInArrow(_marks, "doc_id long, n long, key binary"), "set-keys")
    classes = marks.filter("n > 0").groupBy("key").agg(
        F.min("doc_id").alias("doc"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    total = marks.agg(F.sum("n")).first()[0] or 0
    n_ranges = max(64, int(THETA * total) // RANGE_SHINGLES)
    hits = docs.mapInArrow(_sketches(n_ranges), "range long, chunk long, hashes binary, owner binary, "
                           "doc_id long, need long")
    rich = hits.groupBy("range").applyInArrow(
        _shared, "chunk long, owner binary, doc_id long, need long").groupBy("chunk").applyInArrow(
        _enough, "doc_id long")
    rich = stored(rich.distinct().join(classes.select(F.col("doc").alias("doc_id")).distinct(), "doc_id"),
                  "rich")
    sets = stored(docs.join(lookup(rich), "doc_id", "left_semi").mapInArrow(
        _whole_sets, "doc long, n long, shingles array<long>, bits binary"), "sets")
    lists = _lists(sets)
    known = sets.select("doc", "n", "bits")
    members = stored(lists.join(known, "doc"), "members")
    alone = members.withColumn("component", F.col("doc"))
    links = stored(_linked(stored(_candidates(alone, True), "forest"), sets), "forest-links")
    merged = stored(components(links), "merged").withColumnsRenamed({"node": "doc"})
    now = members.join(lookup(merged), "doc", "left").withColumn(
        "component", F.coalesce("component", "doc"))
    mixed = now.groupBy("kind", "list").agg(
        F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    rest = stored(now.join(mixed.select("kind", "list"), ["kind", "list"]), "mixed")
    more = stored(_linked(stored(_candidates(rest, False), "rest"), sets), "rest-links")
    links = links.unionByName(more).distinct()
    found = stored(components(links), "linked").withColumnsRenamed({"node": "doc"})
    together = classes.join(lookup(found), "doc", "left").select(
        "key", F.col("doc").alias("class_id"), F.coalesce("component", "doc").alias("component_id"),
        "copies").filter("copies > 1 or class_id <> component_id").drop("copies")
    out = marks.join(lookup(stored(together, "classes")), "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("component_id", "doc_id").alias("component_id"))
    return out, links
