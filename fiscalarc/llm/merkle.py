"""Merkle manifest of a dataset, and proofs checked by a recursive climb.

A leaf is the hash of a row. Per source the leaves ascend by ``doc_id``; every ``FANOUT`` consecutive
nodes of a level become one node of the next, until one is left. The sources' roots, in order, are the
leaves of a tree of their own, whose root is the dataset's.

Every built level is stored as node rows that name their parent and their place under it. The check
of the proofs is one recursive query over these rows: a state begins with the leaves under one
first-level node, each with its own hash (the tampered one, where a row was tampered with), and
ascends to the parent until there is none. Each step appends the siblings to the proof and folds
every leaf's own hash with them. Leaves under one node share all siblings above it, so a state holds
the shared part of the proof once for at most ``FANOUT`` leaves.

No join of the climb has a hot key: nodes are stored once per lane, a lane being ``LANE`` first-level
nodes of a source, and a climb stays in its lane. Levels below the one that spans a lane lie in one
lane anyway; the few above are repeated per lane.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import windowed
from .shared import stored

#: children of a node, and first-level nodes of a lane (a power of the fan-out)
FANOUT, LANE = 16, 4096
_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """``-`` for null, else the length in bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(**changed: Column) -> Column:
    """The hash of a row of documents; ``changed`` fields stand in for its own."""
    return F.sha2(F.concat(*[encoded(changed.get(f, F.col(f))) for f in FIELDS]), 256)


def tampered(hit: Column) -> Column:
    """The leaf of a row whose text has its A-Z lower-cased where ``hit`` holds, else its own leaf."""
    return leaf_hash(text=F.when(hit, F.translate("text", *_LOWER)).otherwise(F.col("text")))


def _raw(hexed: Column) -> Column:
    return F.unhex(hexed)


def _text(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def _levels(leaves: DataFrame) -> tuple[DataFrame | None, DataFrame, int]:
    """The nodes above the leaves (tree, place, width, hash) of all trees, with the hashes of their
    children; the roots; and the number of levels.

    ``width`` is the number of nodes of a level in its tree, so a root is the node of a level of one.
    A tree of one leaf has that leaf as its root and no node.
    """
    columns = "tree", F.lit(0).alias("level"), "place", "width", "hash"
    below, nodes, depth = leaves.select(*columns), None, 0
    roots = below.filter("width = 1")
    widest = leaves.agg(F.max("width").alias("w")).first()["w"] or 0
    while widest > 1:
        depth, widest = depth + 1, -(-widest // FANOUT)
        level = below.filter("width > 1").groupBy("tree", F.floor(F.col("place") / FANOUT).alias("place")).agg(
            F.ceil(F.max("width") / FANOUT).alias("width"),
            F.array_sort(F.collect_list(F.struct("place", "hash"))).alias("kids")).select(
            "tree", F.lit(depth).alias("level"), "place", "width",
            F.transform("kids", lambda k: k["hash"]).alias("kids"))
        level = stored(level.withColumn("hash", _raw(F.sha2(F.concat_ws("", F.transform(
            "kids", _text)), 256))), f"level-{depth}")
        nodes = level if nodes is None else nodes.unionByName(level)
        below = level.select("tree", "level", "place", "width", "hash")
        roots = roots.unionByName(below.filter("width = 1"))
    return nodes, roots.select("tree", "level", "hash"), depth


def _joined(hashes: Column) -> Column:
    return F.aggregate(hashes, F.lit(b""), lambda a, b: F.concat(a, b))


def _power(exponent: Column) -> Column:
    return F.pow(F.lit(FANOUT), exponent).cast("long")


def _lane(number: Column) -> Column:
    return F.concat_ws("/", number.cast("long").cast("string"), "tree")


def _steps(nodes: DataFrame | None, above: DataFrame | None, height: int, lanes: DataFrame) -> DataFrame:
    """Node rows, each with the link to its parent and the hashes before and after its own there.

    ``done`` holds if the parent is the root of the dataset.
    """
    def beside(kids: str, at: Column) -> list[Column]:
        return [_joined(F.slice(kids, 1, at)).alias("before"),
                _joined(F.slice(kids, at + 2, FANOUT)).alias("after")]

    link = ["lane", "tree", "level", "place", "up_tree", "up_level", "up_place", "before", "after", "done"]
    out = lanes.sparkSession.createDataFrame([], _STEP)
    if nodes is not None:
        kids = nodes.filter("level > 1").select("*", F.posexplode("kids").alias("at", "kid")).select(
            "tree", (F.col("level") - 1).alias("level"), (F.col("place") * FANOUT + F.col("at")).alias("place"),
            F.col("tree").alias("up_tree"), F.col("level").alias("up_level"), F.col("place").alias("up_place"),
            *beside("kids", F.col("at")),
            ((F.col("width") == 1) & F.lit(above is None)).alias("done"))
        # the lanes below a node; the last node of a level may name some more, which nobody climbs
        span = _power(F.col("level") - 1)
        first, last = F.col("place") * span, (F.col("place") + 1) * span - 1
        kids = kids.withColumn("number", F.explode(F.sequence(F.floor(first / LANE), F.floor(last / LANE))))
        out = out.unionByName(kids.select(_lane(F.col("number")).alias("lane"), *link[1:]))
    if above is not None:
        hops = lanes.withColumn("up_level", F.explode(F.sequence(F.lit(1), F.lit(height)))).withColumn(
            "up_place", F.floor(F.col("upper") / _power(F.col("up_level"))))
        hops = hops.join(above.select(F.col("level").alias("up_level"), F.col("place").alias("up_place"),
                                      F.col("width").alias("w"), "kids"), ["up_level", "up_place"])
        from_source, own = F.col("up_level") == 1, F.floor(F.col("upper") / _power(F.col("up_level") - 1))
        out = out.unionByName(hops.select(
            "lane", F.when(from_source, F.col("tree")).otherwise("").alias("tree"),
            F.when(from_source, F.col("root_level")).otherwise(F.col("up_level") - 1).alias("level"),
            F.when(from_source, F.lit(0)).otherwise(own).alias("place"),
            F.lit("").alias("up_tree"), "up_level", "up_place",
            *beside("kids", (own % FANOUT).cast("int")), (F.col("w") == 1).alias("done")))
    return stored(out, "steps")


_STEP = ("lane string, tree string, level int, place long, up_tree string, up_level int, up_place long, "
         "before binary, after binary, done boolean")

#: one state per first-level node, or per leaf that is the root of its source
_CLIMB = """
WITH RECURSIVE climb (lane, tree, level, place, kids, leaves, proof, done) AS (
  SELECT lane, tree, level, place, kids, leaves, proof, done FROM {start}
  UNION ALL
  SELECT c.lane, n.up_tree, n.up_level, n.up_place, c.kids,
    transform(c.leaves, x -> named_struct('doc_id', x.doc_id, 'at', x.at, 'folded', unhex(sha2(
      concat(lower(hex(n.before)), lower(hex(x.folded)), lower(hex(n.after))), 256)))),
    concat(c.proof, n.before, n.after), n.done
  FROM climb c JOIN {steps} n
    ON c.lane = n.lane AND c.tree = n.tree AND c.level = n.level AND c.place = n.place
  WHERE NOT c.done)
SELECT lane, kids, leaves, proof FROM climb WHERE done"""


def _climbed(start: DataFrame, steps: DataFrame) -> DataFrame:
    """Every state at the root of the dataset."""
    spark, limit = start.sparkSession, "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit, None)
    spark.conf.set(limit, "-1")
    try:
        return stored(spark.sql(_CLIMB, start=start, steps=steps), "climbed")
    finally:
        if before is None:
            spark.conf.unset(limit)
        else:
            spark.conf.set(limit, before)


def manifest(docs: DataFrame, changed: Column) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, and source.

    ``folded_root`` is what the climb reaches from the row's leaf, that of its tampered text where
    the condition ``changed`` holds. A null source is a source, the first one; rows without a
    ``doc_id`` are its first leaves; rows that share one ascend by leaf, and equal rows in any order.
    A lone leaf is its source's root, and a lone source's root the dataset's. An empty table gives no
    rows; other columns are not read.
    """
    tree = F.when(F.col("source").isNull(), "n").otherwise(
        F.concat(F.lit("s"), F.col("source").cast("string")))
    own = stored(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), _raw(leaf_hash()).alias("hash"),
        _raw(tampered(F.coalesce(changed, F.lit(False)))).alias("own")), "leaves")
    leaves = stored(windowed(own, ["tree"], [F.col("doc_id"), F.col("hash"), F.col("own")],
                             place=("row_number",), width=("size",)).withColumn(
        "place", F.col("place") - 1), "placed-leaves")
    nodes, roots, _ = _levels(leaves)
    roots = stored(roots, "subroots")
    upper = stored(windowed(roots, [], [F.col("tree")], place=("row_number",), width=("size",)).withColumn(
        "place", F.col("place") - 1), "placed-subroots")
    above, top, height = _levels(upper.withColumn("tree", F.lit("")))
    root = top.first()
    if root is None:
        return docs.sparkSession.createDataFrame([], _RESULT)

    widths = leaves.groupBy("tree").agg(F.max("width").alias("leaves"))
    lanes = upper.select("tree", F.col("place").alias("upper"), F.col("level").alias("root_level"),
                         F.col("hash").alias("subroot")).join(widths, "tree")
    last = F.floor((F.col("leaves") - 1) / (FANOUT * LANE))
    lanes = lanes.withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    lanes = stored(lanes.select(_lane(F.col("number")).alias("lane"), "tree", "upper", "root_level",
                                "subroot"), "lanes")

    # the step above the leaves is done here: all leaves under one node, each folded with the others
    runs = leaves.groupBy("tree", F.floor(F.col("place") / FANOUT).alias("node")).agg(
        F.max("width").alias("width"), F.array_sort(F.collect_list(F.struct(
            "place", "doc_id", "hash", "own"))).alias("run"))
    kids = F.transform("run", lambda x: x["hash"])

    def folded(x: Column, at: Column) -> Column:
        others = F.concat(F.concat_ws("", F.transform(F.slice(kids, 1, at), _text)), _text(x["own"]),
                          F.concat_ws("", F.transform(F.slice(kids, at + 2, FANOUT), _text)))
        return F.when(F.col("width") == 1, x["own"]).otherwise(_raw(F.sha2(others, 256)))

    start = runs.select(
        _lane(F.floor(F.col("node") / LANE)).alias("lane"), "tree",
        F.when(F.col("width") > 1, 1).otherwise(0).alias("level"), F.col("node").alias("place"),
        _joined(kids).alias("kids"),
        F.transform("run", lambda x, at: F.struct(x["doc_id"].alias("doc_id"), at.alias("at"),
                                                  folded(x, at).alias("folded"))).alias("leaves"),
        F.lit(b"").alias("proof"),
        (F.lit(above is None) & (F.col("width") <= FANOUT)).alias("done"))
    ended = _climbed(stored(start, "climb-start"), _steps(nodes, above, height, lanes))

    each = ended.join(lanes.select("lane", "tree", "subroot"), "lane").select(
        "kids", "proof", "tree", "subroot", F.explode("leaves").alias("x")).select(
        "*", (F.col("x.at") * 32).alias("at"))
    whole = _text(F.lit(bytes(root["hash"])))
    first = F.concat(F.substring("kids", F.lit(1), F.col("at")),
                     F.substring("kids", F.col("at") + 33, F.lit(FANOUT * 32)))
    return each.select(
        F.col("x.doc_id").alias("doc_id"),
        _text(F.substring("kids", F.col("at") + 1, F.lit(32))).alias("leaf"),
        _text(F.col("subroot")).alias("subroot"), whole.alias("root"),
        F.sha2(_text(F.concat(first, "proof")), 256).alias("proof_sha256"),
        _text(F.col("x.folded")).alias("folded_root"),
        (F.col("x.folded") == F.lit(bytes(root["hash"]))).alias("verified"),
        F.when(F.col("tree") != "n", F.expr("substring(tree, 2)")).alias("source"))


_RESULT = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
           "folded_root string, verified boolean, source string")
