"""Graph, hierarchy and lineage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import normalise_label
from ..scale import small, windowed
from ..session import cut, dropped, freed


def build_graph(parts: list[tuple[DataFrame, str, str, str, str, str, float]]) -> tuple[DataFrame, DataFrame]:
    """Nodes and typed edges. A part is (frame, src, dst, relation, kind, source, confidence);
    ids carry their type before a colon."""
    edges = reduce(DataFrame.unionByName, [
        df.select(F.col(s).alias("src"), F.col(d).alias("dst"), F.lit(rel).alias("relation"),
                  F.lit(kind).alias("kind"), F.lit(source).alias("source"),
                  F.lit(conf).alias("confidence")) for df, s, d, rel, kind, source, conf in parts])
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    nodes = ends.withColumn("type", F.split("id", ":")[0])
    return nodes, edges


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def hierarchy_closure(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """Ancestor–descendant pairs with depth, by doubling: the pairs up to twice the known depth are the
    deepest known ones followed by all known ones, so a hierarchy of depth d takes log2(d) rounds and
    every pair is made once. A node above itself is an error; a node may have several parents, and
    then a pair has a row per path."""
    known = cut(edges.select(F.col(child).alias("descendant"), F.col(parent).alias("ancestor"),
                             F.lit(1).alias("depth")).filter(
        F.col("descendant").isNotNull() & F.col("ancestor").isNotNull()))
    reach = 1
    while True:
        if not known.filter("descendant = ancestor").isEmpty():
            raise ValueError("hierarchy is cyclic")
        deepest = known.filter(F.col("depth") == reach).select(
            "descendant", F.col("ancestor").alias("_via"))
        more = cut(deepest.join(known.select(F.col("descendant").alias("_via"), "ancestor", "depth"), "_via")
                   .select("descendant", "ancestor", (F.col("depth") + reach).alias("depth")))
        if more.isEmpty():
            return known
        # both parts are written: nothing is computed twice
        known, reach = known.unionByName(more), 2 * reach


def subtree_intervals(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(node, pre, post) of every node of a forest: what lies below a node, and the node itself, are
    the nodes with ``pre`` between its ``pre`` and ``post``.

    Siblings and roots ascend by id. A node's place is the sum, over it and all above it, of one and
    the sizes of the earlier siblings; sizes come from the closure, sums of siblings from a window
    that a parent of very many children does not slow down.
    """
    closure = hierarchy_closure(edges, child, parent)
    links = edges.select(F.col(child).alias("node"), F.col(parent).alias("_up")).filter(
        F.col("node").isNotNull() & F.col("_up").isNotNull())
    roots = links.select(F.col("_up").alias("node")).distinct().join(
        links.select("node"), "node", "left_anti").withColumn("_up", F.lit(None).cast(links.schema["_up"].dataType))
    size = closure.groupBy(F.col("ancestor").alias("node")).agg(F.count(F.lit(1)).alias("_below"))
    sized = cut(links.unionByName(roots).join(size, "node", "left").withColumn(
        "size", F.coalesce("_below", F.lit(0)) + 1).drop("_below"))
    placed = cut(windowed(sized, ["_up"], [F.col("node")], _earlier=("sum_before", "size")).select(
        "node", "size", (F.coalesce("_earlier", F.lit(0)) + F.when(F.col("_up").isNull(), 0).otherwise(1))
        .alias("_step")))
    above = closure.join(placed.select(F.col("node").alias("ancestor"), "_step"), "ancestor").groupBy(
        F.col("descendant").alias("node")).agg(F.sum("_step").alias("_above"))
    pre = F.col("_step") + F.coalesce("_above", F.lit(0))
    return placed.join(above, "node", "left").select("node", pre.alias("pre"),
                                                     (pre + F.col("size") - 1).alias("post"))


#: so many pairs of kinds of nodes are looked at, and so many edges are sent to all tasks
KIND_PAIRS, SENT_EDGES = 200, 100_000


def _kind(ident: str) -> Column:
    return F.substring_index(ident, ":", 1)


def _kind_pairs(e: DataFrame) -> set[tuple[str, str]] | None:
    """The kinds of nodes that edges join, if all ids carry one before a colon and they are few."""
    ends = ("previous", "node")
    if any(e.schema[c].dataType.simpleString() != "string" for c in ends) or not e.filter(
            " OR ".join(f"instr({c}, ':') = 0" for c in ends)).isEmpty():
        return None
    pairs = e.select(*[_kind(c).alias(c) for c in ends]).distinct().limit(KIND_PAIRS + 1).collect()
    return {tuple(r) for r in pairs} if len(pairs) <= KIND_PAIRS else None


def _layered(pairs: set[tuple[str, str]] | None) -> bool:
    """Whether the kinds have levels such that every edge goes one level on. Then all ways between two nodes
    have one length, and no round meets a node that an earlier one reached from the same start."""
    level: dict[str, int] = {}
    todo = list(pairs or ())
    while todo:
        a, b = next(((x, y) for x, y in todo if x in level or y in level), todo[0])
        todo.remove((a, b))
        if a not in level and b not in level:
            level[a] = 0
        level.setdefault(b, level.get(a, 0) + 1)
        if level.setdefault(a, level[b] - 1) + 1 != level[b]:
            return False
    return pairs is not None


def lineage_trace(edges: DataFrame, starts: DataFrame, direction: str = "up", paths: bool = False) -> DataFrame:
    """Everything upstream or downstream of the start nodes: (start, node, previous, depth).

    A round goes one step from the nodes the last one found and keeps those not reached before, so
    rows grow with nodes and edges and not with the number of paths, and cycles end. ``depth`` is the
    least number of steps and ``previous`` the node before on a shortest path, the least of several;
    ``lineage_paths`` follows it back to the start. With ``paths`` the rounds carry ``path``, the nodes of
    that path after the start, so that nothing is followed back. The edges are written once.

    Where the ids carry few kinds, a round reads only edges from the kinds it has reached, and if the kinds
    form layers nothing can be reached twice. As long as every node there has one edge on, a start has one
    row in each round and none are merged.
    """
    a, b = ("dst", "src") if direction == "up" else ("src", "dst")
    e = freed(edges.select(F.col(a).alias("previous"), F.col(b).alias("node")).filter(
        F.col("previous").isNotNull() & F.col("node").isNotNull()), "edges")
    kind = e.schema["node"].dataType
    begin = freed(starts.select(F.col("id").alias("start")).filter("start is not null").distinct(), "reached")
    # what a round writes besides start and node: the way between them, or its last node
    kept = "way" if paths else "previous"
    none = F.array().cast(f"array<{kind.simpleString()}>") if paths else F.lit(None).cast(kind)
    frontier = begin.select("start", F.col("start").alias("node"), none.alias(kept))
    pairs = _kind_pairs(e)
    layered, single, found = _layered(pairs), True, [frontier]
    if pairs is not None:
        first = _kind("start").alias("kind")
        kinds = {r["kind"] for r in begin.select(first).filter(F.col("kind").isin(
            sorted({x for x, _ in pairs}))).distinct().collect()} if pairs else set()
    while pairs is None or any(x in kinds for x, _ in pairs):
        layer = e if pairs is None else e.filter(_kind("previous").isin(sorted(kinds)))
        here = frontier.select("start", F.col("node").alias("previous"), *([kept] if paths else []))
        own = ["previous", "way"] if paths else ["previous"]
        if not paths:
            way = F.col("previous")
        elif len(found) == 1:
            way = none  # the start itself is not on the way
        else:
            way = F.concat("way", F.array("previous"))
        step = None
        if single and layered:
            n, nodes = layer.agg(F.count(F.lit(1)), F.approx_count_distinct("previous", 0.02)).first()
            if n <= 1.1 * nodes:
                one = layer.groupBy("previous").agg(F.min("node").alias("node"), F.max("node").alias("_other"))
                step = freed(here.join(F.broadcast(one) if nodes <= SENT_EDGES else one, "previous").select(
                    "start", "node", way.alias(kept), (F.col("node") < F.col("_other")).alias("_more")), "reached")
                if not step.filter("_more").isEmpty():
                    dropped(step)
                    step = None
        if step is None:
            single = False
            steps = here.join(layer, "previous").groupBy("start", "node").agg(F.min(F.struct(*own)).alias("_l")) \
                .select("start", "node", "_l.*").select("start", "node", way.alias(kept))
            # a node is new unless an earlier round reached it
            step = freed(steps if layered else steps.join(
                _union(found).select("start", "node"), ["start", "node"], "left_anti"), "reached")
        frontier = step.select("start", "node", kept)
        if frontier.isEmpty():
            break
        found.append(frontier)
        if pairs is not None:
            kinds = {y for x, y in pairs if x in kinds}
    traced = []
    for depth, part in enumerate(found[1:], 1):
        last = F.col("previous") if not paths else F.col("start") if depth == 1 else F.element_at("way", -1)
        traced.append(part.select("start", "node", last.alias("previous"), F.lit(depth).alias("depth"), *(
            [F.concat("way", F.array("node")).alias("path")] if paths else [])))
    empty = frontier.limit(0).select("start", "node", F.col("node").alias("previous"), F.lit(0).alias("depth"), *(
        [F.col("way").alias("path")] if paths else []))
    return _union(traced) if traced else empty


def lineage_paths(traced: DataFrame) -> DataFrame:
    """``lineage_trace`` with the shortest path from the start to each node as an array.

    Paths that the trace did not carry are joined by doubling along ``previous``: log2(depth) rounds.
    """
    if "path" in traced.columns:
        return traced.select("start", "node", "depth", F.concat(F.array("start"), "path").alias("path"))
    depth = traced.agg(F.max("depth").alias("d")).first()["d"] or 0
    # the path between an ancestor on the way (exclusive) and the node; starts lead to themselves
    state = cut(traced.select("start", "node", "depth", F.col("previous").alias("_at"),
                              F.array("node").alias("path")))
    reach = 1
    while reach < depth:
        head = state.select("start", F.col("node").alias("_at"), F.col("_at").alias("_next"),
                            F.col("path").alias("_head"))
        state = cut(state.join(head, ["start", "_at"], "left").select(
            "start", "node", "depth", F.coalesce("_next", "_at").alias("_at"),
            F.when(F.col("_head").isNull(), F.col("path")).otherwise(F.concat("_head", "path")).alias("path")))
        reach *= 2
    return state.select("start", "node", "depth", F.concat(F.array("start"), "path").alias("path"))


def cycles(edges: DataFrame) -> DataFrame:
    """(node, cycle) of the nodes on cycles of (before_id, after_id): the strongly connected parts of two
    nodes or more, or with an edge to itself; ``cycle`` is the least node of the part.

    Edges that start where none arrives, or end where none leaves, are trimmed until none is left.
    Then every node learns the least node that reaches it; what reaches that node again among the
    nodes of the same label is its part. Parts are taken out and the rest goes on. Only nodes whose
    label changed send it on.
    """
    e = freed(edges.select("before_id", "after_id").filter(
        F.col("before_id").isNotNull() & F.col("after_id").isNotNull()).distinct(), "cycles")
    found = []
    while True:
        size = e.count()
        while size:
            e = freed(e.join(e.select(F.col("after_id").alias("before_id")).distinct(), "before_id", "left_semi")
                      .join(e.select(F.col("before_id").alias("after_id")).distinct(), "after_id", "left_semi"),
                      "cycles")
            size, last = e.count(), size
            if size == last:
                break
        if not size:
            break
        label = cut(e.select(F.col("before_id").alias("node")).distinct().withColumn("label", F.col("node")))
        changed = label
        while not changed.isEmpty():
            told = changed.select(F.col("node").alias("before_id"), "label").join(e, "before_id").groupBy(
                F.col("after_id").alias("node")).agg(F.min("label").alias("_new"))
            changed = cut(label.join(told, "node").filter("_new < label").select(
                "node", F.col("_new").alias("label")))
            label = cut(label.join(changed.withColumnRenamed("label", "_new"), "node", "left").select(
                "node", F.coalesce("_new", "label").alias("label")))
        inside = cut(e.join(label.select(F.col("node").alias("before_id"), "label"), "before_id").join(
            label.select(F.col("node").alias("after_id"), F.col("label").alias("_to")), "after_id")
            .filter("label = _to").select("before_id", "after_id", "label"))
        part = cut(label.filter("node = label"))
        frontier, parts = part, [part]
        while not frontier.isEmpty():
            back = frontier.select(F.col("node").alias("after_id"), "label").join(
                inside, ["after_id", "label"]).select(F.col("before_id").alias("node"), "label").distinct()
            frontier = cut(back.join(_union(parts).select("node"), "node", "left_anti"))
            parts.append(frontier)
        part = cut(_union(parts))
        looped = e.filter("before_id = after_id").select(F.col("before_id").alias("label")).distinct()
        several = part.groupBy("label").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("label")
        found.append(cut(part.join(several.unionByName(looped).distinct(), "label", "left_semi").select(
            "node", F.col("label").alias("cycle"))))
        for end in ("before_id", "after_id"):
            e = e.join(part.select(F.col("node").alias(end)), end, "left_anti")
        e = cut(e.select("before_id", "after_id"))
    if found:
        return _union(found)
    return e.select(F.col("before_id").alias("node"), F.col("after_id").alias("cycle")).limit(0)


def dependency_risk(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """Tasks with a late predecessor, near or far: (task_id, late, at_risk, steps, nearest, cycle).

    ``tasks`` has task_id and late, ``deps`` before_id and after_id. The risk goes from the late tasks
    along the dependencies, one step a round, and each round moves only the tasks it reached for the
    first time: ``steps`` is the distance of the nearest late predecessor, ``nearest`` the least such
    one. ``cycle`` names the cycle a task is on by its least task. Dependencies on unknown tasks count
    for nothing; a null ``late`` is not late; a late task is at risk if a late one is before it, on a
    cycle also itself.
    """
    known = tasks.select("task_id", F.coalesce("late", F.lit(False)).alias("late"))
    e = cut(_known(deps, known))
    frontier = cut(known.filter("late").select("task_id", F.col("task_id").alias("nearest")))
    reached, found = None, []
    while True:
        told = frontier.select(F.col("task_id").alias("before_id"), "nearest").join(e, "before_id").groupBy(
            F.col("after_id").alias("task_id")).agg(F.min("nearest").alias("nearest"))
        if found:
            told = told.join(_union(found).select("task_id"), "task_id", "left_anti")
        frontier = cut(told.withColumn("steps", F.lit(len(found) + 1)))
        found.append(frontier)
        if frontier.isEmpty():
            break
    reached = _union(found)
    return known.join(reached, "task_id", "left").join(
        cycles(e).withColumnRenamed("node", "task_id"), "task_id", "left").select(
        "task_id", "late", F.col("steps").isNotNull().alias("at_risk"), "steps", "nearest", "cycle")


def _known(deps: DataFrame, tasks: DataFrame) -> DataFrame:
    """The dependencies between known tasks, once each. The last join has dealt them by ``after_id``, and so
    equal ones lie together."""
    e = deps.select("before_id", "after_id")
    for end in ("before_id", "after_id"):
        e = e.join(tasks.select(F.col("task_id").alias(end)), end, "left_semi")
    return e.select("before_id", "after_id").distinct()


def critical_path(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """Earliest start and finish of tasks in a dependency graph: (task_id, duration, start, finish, driver,
    cycle).

    ``tasks`` has task_id and duration, ``deps`` before_id and after_id. A round settles the tasks all
    of whose predecessors are settled and writes only those; what they tell their successors waits, one
    row per waiting task, until the last predecessor has told. There are as many rounds as the longest
    chain has steps. ``driver`` is the predecessor that ends last, the least of several: from any task
    it leads back along its critical path. Tasks on a cycle, or behind one, have no start; ``cycle``
    names a task's own cycle by its least task. Dependencies on unknown tasks count for nothing; a null
    duration is 0.
    """
    known = tasks.select("task_id", F.coalesce("duration", F.lit(0)).cast("long").alias("duration"))
    e = freed(_known(deps, known), "edges")
    wanted = e.groupBy(F.col("after_id").alias("task_id")).agg(F.count(F.lit(1)).alias("wanted"))
    state = freed(known.join(wanted, "task_id", "left"), "tasks")
    settled = state.filter("wanted is null").select(
        "task_id", "duration", F.lit(0).cast("long").alias("start"),
        F.lit(None).cast(known.schema["task_id"].dataType).alias("driver"))
    state = state.filter("wanted is not null")  # the others are never told
    done, waiting = [settled], None
    while not settled.isEmpty():
        told = settled.select(F.col("task_id").alias("before_id"), (F.col("start") + F.col("duration")).alias("_f")) \
            .join(e, "before_id").groupBy(F.col("after_id").alias("task_id")).agg(
            F.max("_f").alias("start"), F.count(F.lit(1)).alias("heard"),
            F.min_by("before_id", F.struct(-F.col("_f"), F.col("before_id"))).alias("driver"))
        if waiting is not None:
            told = told.unionByName(waiting).groupBy("task_id").agg(
                F.max("start").alias("_s"), F.sum("heard").alias("heard"),
                F.min_by("driver", F.struct(-F.col("start"), F.col("driver"))).alias("driver")).withColumnRenamed(
                "_s", "start")
        told = freed(told.join(state, "task_id"), "told")
        settled = told.filter("heard = wanted").select("task_id", "duration", "start", "driver")
        waiting = told.filter("heard < wanted").select("task_id", "start", "heard", "driver")
        done.append(settled)
    ready = _union(done)
    left = e.join(ready.select(F.col("task_id").alias("before_id")), "before_id", "left_anti")
    return known.join(ready.drop("duration"), "task_id", "left").join(
        cycles(left).withColumnRenamed("node", "task_id"), "task_id", "left").select(
        "task_id", "duration", "start", (F.col("start") + F.col("duration")).alias("finish"), "driver", "cycle")


def earliest_finish(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """``critical_path`` for plans that must have no cycle: (task_id, duration, finish), or an error."""
    out = cut(critical_path(tasks, deps))
    if not out.filter("start is null").isEmpty():
        raise ValueError("dependencies are cyclic")
    return out.select("task_id", "duration", "finish")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of undirected links (a, b): the least node they reach.

    Large-star and small-star steps point neighbours at the least node they know of until nothing
    changes, about as many as the logarithm of the longest path. Minima are combined map-side.
    """
    edges = cut(links.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = cut(both.join(least, "a").filter("b > a").select(
            F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = cut(large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                    .unionByName(least.select("a", F.col("m").alias("b")))
                    .filter("a <> b").distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(
            F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = now


def connected(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Connected components of a bipartite graph (item, key): the least item id of each item's
    component. Every key links its items with its least one."""
    e = cut(edges.select(F.col(left).alias("_i"), F.col(right).alias("_k")).distinct())
    hub = e.groupBy("_k").agg(F.min("_i").alias("b"))
    found = components(e.join(hub, "_k").select(F.col("_i").alias("a"), "b"))
    return e.select("_i").distinct().join(found, F.col("_i") == F.col("node"), "left").select(
        F.col("_i").alias(left), F.coalesce("component", "_i").alias("entity"))


def resolve_entities(names: DataFrame, ident: str, name: str, aliases: DataFrame | None = None
                     ) -> DataFrame:
    """Merge spellings into entities.

    Names meet when their normal forms are equal, when they differ by one edited letter (they
    share a form with one letter left out) and carry the same digits, or when the alias table
    (alias, canonical) says so. The entity is the least id of the connected names.
    """
    label = normalise_label(name)
    compact = F.regexp_replace(label, " ", "")
    digits = F.regexp_replace(compact, "[^0-9]", "")
    letters = F.regexp_replace(compact, "[0-9]", "")
    forms = names.select(ident, label.alias("_full"), letters.alias("_l"), digits.alias("_d"))
    # one row per letter left out (0 leaves the name whole); short names must match exactly
    cuts = forms.select(ident, "_l", "_d", F.explode(F.sequence(
        F.lit(0), F.when(F.length("_l") >= 4, F.length("_l")).otherwise(0))).alias("_i"))
    form = F.when(F.col("_i") == 0, F.col("_l")).otherwise(F.concat(
        F.substring(F.col("_l"), F.lit(1), F.col("_i") - 1),
        F.substring(F.col("_l"), F.col("_i") + 1, F.length("_l"))))
    keys = cuts.select(ident, F.concat(form, F.lit("|"), "_d").alias("_key"))
    if aliases is not None:
        known = aliases.select(normalise_label("alias").alias("_full"),
                               normalise_label("canonical").alias("_canon"))
        told = forms.join(small(known), "_full").select(
            ident, F.concat(F.lit("="), "_canon").alias("_key"))
        own = forms.join(small(known.select(F.col("_canon").alias("_full")).distinct()),
                         "_full").select(ident, F.concat(F.lit("="), "_full").alias("_key"))
        keys = keys.unionByName(told).unionByName(own)
    return connected(keys, ident, "_key")


def graph_contradictions(edges: DataFrame) -> DataFrame:
    """Relations for which sources name different targets; every assertion is kept."""
    per = edges.groupBy("src", "relation", "dst").agg(
        F.count(F.lit(1)).alias("n_assertions"), F.min("source").alias("first_source"))
    split = per.groupBy("src", "relation").agg(F.count(F.lit(1)).alias("n_targets")).filter(
        "n_targets > 1")
    return per.join(split, ["src", "relation"])
