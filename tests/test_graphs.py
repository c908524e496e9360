"""Graph and hierarchy operators against plain versions: cycles, joins, forks, nulls, hot nodes, no rows."""

import random
from collections import defaultdict, deque
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from fiscalarc.operators import derive, graph

EDGES = "before_id long, after_id long"


def random_graph(seed, n=60, m=90, cyclic=True):
    rng = random.Random(seed)
    edges = set()
    while len(edges) < m:
        a, b = rng.randrange(n), rng.randrange(n)
        edges.add((a, b) if cyclic or a < b else (b, a))
    return [(a, b) for a, b in edges if cyclic or a != b]


def reach(edges, n):
    after = defaultdict(set)
    for a, b in edges:
        after[a].add(b)
    out = {}
    for s in range(n):
        seen, todo = set(), [s]
        while todo:
            for b in after[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out[s] = seen
    return out


@pytest.mark.parametrize("seed", range(3))
def test_cycles(spark, seed):
    edges = random_graph(seed)
    far = reach(edges, 60)
    want = {s: min(t for t in far[s] if s in far[t]) for s in range(60) if s in far[s]}
    rows = spark.createDataFrame(edges + edges[:3] + [(None, 1), (1, None)], EDGES)
    assert {r["node"]: r["cycle"] for r in graph.cycles(rows).collect()} == want
    assert graph.cycles(rows.limit(0)).collect() == []


def test_separate_cycles_are_told_apart(spark):
    # two cycles joined by a path, one node on itself, a tail and a head
    edges = [(9, 1), (1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 6), (6, 4), (7, 7), (6, 8)]
    got = {r["node"]: r["cycle"] for r in graph.cycles(spark.createDataFrame(edges, EDGES)).collect()}
    assert got == {1: 1, 2: 1, 4: 4, 5: 4, 6: 4, 7: 7}


def plain_schedule(duration, edges):
    wanted, after = defaultdict(set), defaultdict(set)
    for a, b in edges:
        if a in duration and b in duration:
            wanted[b].add(a)
            after[a].add(b)
    finish, start, driver = {}, {}, {}
    todo = deque(t for t in duration if not wanted[t])
    while todo:
        t = todo.popleft()
        last = min(wanted[t], key=lambda p: (-finish[p], p)) if wanted[t] else None
        start[t], driver[t] = (finish[last] if last is not None else 0), last
        finish[t] = start[t] + duration[t]
        for b in after[t]:
            if b not in finish and all(p in finish for p in wanted[b]) and b not in todo:
                todo.append(b)
    return start, finish, driver


@pytest.mark.parametrize("cyclic", [False, True])
def test_critical_path(spark, cyclic):
    rng = random.Random(4)
    edges = random_graph(5, n=50, m=70, cyclic=cyclic) + [(1000, 3), (3, 1001)]
    edges += [(100, 101 + i) for i in range(30)] + [(101 + i, 200) for i in range(30)]  # a fork and a join
    edges += [(300 + i, 301 + i) for i in range(25)]  # a long chain
    tasks = {t: rng.choice([0, 1, 5, 5, 9]) for t in [*range(50), *range(100, 132), 200, *range(300, 326)]}
    rows = [(t, d) for t, d in tasks.items()] + [(400, None)]
    got = graph.critical_path(spark.createDataFrame(rows, "task_id long, duration long"),
                              spark.createDataFrame(edges + edges[:5], EDGES)).collect()
    start, finish, driver = plain_schedule(tasks | {400: 0}, edges)
    assert len(got) == len(rows)
    far = reach([e for e in edges if e[0] in tasks and e[1] in tasks], 50)
    for r in got:
        t = r["task_id"]
        assert (r["start"], r["finish"], r["driver"]) == (start.get(t), finish.get(t), driver.get(t))
        on = t in far.get(t, ())
        assert r["cycle"] == (min(s for s in far[t] if t in far[s]) if on else None)


def left_behind(spark, made):
    """MB of shuffles and of checkpoints that ``made`` leaves on disk."""
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()

    def size():
        files = env.blockManager().diskBlockManager().getAllFiles()
        shuffles = {files.apply(i).getPath(): files.apply(i).length() for i in range(files.size())
                    if files.apply(i).getName().startswith("shuffle_")}
        return shuffles, set(Path(urlparse(spark.sparkContext._jsc.sc().getCheckpointDir().get()).path).glob("rdd-*/*"))

    (old, cuts), _, (new, more) = size(), made(), size()
    return (sum(new[f] for f in new.keys() - old.keys()) + sum(f.stat().st_size for f in more - cuts)) / 1e6


def test_critical_path_drops_what_its_rounds_shuffled(spark):
    tasks = spark.range(300_000).selectExpr("id AS task_id", "xxhash64(id) % 100 AS duration")
    deps = spark.range(300_000).selectExpr("id AS before_id", "id + 1 AS after_id").filter("after_id % 6 > 0")
    got = []
    assert left_behind(spark, lambda: got.append(graph.critical_path(tasks, deps))) < 4
    assert got[0].filter("driver = task_id - 1").count() == 250_000


def test_dependency_risk(spark):
    rng = random.Random(6)
    edges = random_graph(7, n=50, m=60)
    late = {t: rng.random() < 0.1 for t in range(50)}
    rows = [(t, None if t == 7 else late[t]) for t in range(50)]
    late[7] = False
    got = graph.dependency_risk(spark.createDataFrame(rows, "task_id long, late boolean"),
                                spark.createDataFrame(edges, EDGES)).collect()
    after = defaultdict(set)
    for a, b in edges:
        after[a].add(b)
    want = {}
    for s in (t for t in range(50) if late[t]):
        seen, level, steps = set(), {s}, 0
        while level:
            level = {b for a in level for b in after[a]} - seen
            seen |= level
            steps += 1
            for t in level:
                want[t] = min(want.get(t, (99, 0)), (steps, s))
    assert {r["task_id"]: (r["steps"], r["nearest"]) for r in got if r["at_risk"]} == want
    assert len(got) == 50 and {r["task_id"] for r in got if r["late"]} == {t for t in late if late[t]}


def forest(seed=2, n=200):
    rng = random.Random(seed)
    parent = {i: rng.randrange(max(0, i - 40), i) if i % 50 else None for i in range(n)}
    parent |= {1000 + i: 0 for i in range(300)}  # a node with very many children
    return parent


def test_intervals_hold_what_is_below(spark, monkeypatch):
    parent = forest()
    edges = [(c, p) for c, p in parent.items()] + [(None, 3)]
    rows = spark.createDataFrame(edges, "child long, parent long")
    spark.conf.set("fiscalarc.split.minBytes", "0")
    spark.conf.set("fiscalarc.split.minRows", "40")  # deal the hot parent into ranges
    try:
        got = {r["node"]: (r["pre"], r["post"]) for r in graph.subtree_intervals(rows, "child", "parent").collect()}
    finally:
        spark.conf.unset("fiscalarc.split.minBytes")
        spark.conf.unset("fiscalarc.split.minRows")
    below = defaultdict(set)
    for c in parent:
        at = c
        while at is not None:
            below[at].add(c)
            at = parent[at]
    assert set(got) == set(below) and sorted(p for p, _ in got.values()) == list(range(len(below)))
    for node, (pre, post) in got.items():
        assert {x for x, (p, _) in got.items() if pre <= p <= post} == below[node]


def test_lineage_is_shortest_and_small(spark):
    # ten diamonds in a row: 1,024 paths, 30 edges
    edges = [e for i in range(10) for e in ((f"n{i}", f"a{i}"), (f"n{i}", f"b{i}"), (f"a{i}", f"n{i + 1}"),
                                           (f"b{i}", f"n{i + 1}"))]
    rows = spark.createDataFrame(edges + [("n0", "n3"), (None, "n1")], "src string, dst string")
    traced = graph.lineage_trace(rows, spark.sql("SELECT explode(array('n0', 'a4', null)) AS id"), "down")
    got = {(r["start"], r["node"]): (r["previous"], r["depth"]) for r in traced.collect()}
    assert len(got) == 30 + 16 and got["n0", "n1"] == ("a0", 2) and got["n0", "n3"] == ("n0", 1)
    paths = {(r["start"], r["node"]): r["path"] for r in graph.lineage_paths(traced).collect()}
    assert paths["n0", "n5"] == ["n0", "n3", "a3", "n4", "a4", "n5"]
    for key, (previous, depth) in got.items():
        assert len(paths[key]) == depth + 1 and paths[key][-2] == previous and paths[key][0] == key[0]
    assert graph.lineage_trace(rows, spark.sql("SELECT 'zz' AS id")).collect() == []
    assert graph.lineage_paths(graph.lineage_trace(rows, spark.sql("SELECT 'zz' AS id"))).collect() == []


def test_carried_paths_equal_followed_ones(spark):
    rng = random.Random(12)
    edges = {(rng.randrange(30), rng.randrange(30)) for _ in range(70)}
    rows = spark.createDataFrame(sorted(edges), "src long, dst long")
    starts = spark.createDataFrame([(3,), (7,), (99,)], "id long")
    for way in ("up", "down"):
        carried = graph.lineage_trace(rows, starts, way, paths=True)
        assert "path" in carried.columns
        followed = graph.lineage_paths(graph.lineage_trace(rows, starts, way))
        got = graph.lineage_paths(carried)
        assert sorted(map(str, got.collect())) == sorted(map(str, followed.collect())) and got.count() > 10
    assert graph.lineage_paths(graph.lineage_trace(rows, starts.limit(0), paths=True)).collect() == []


def test_revisions_reach_everything_below(spark):
    parent = forest()
    leaves = sorted(set(parent) - set(parent.values()))
    rng = random.Random(9)
    amount = {x: rng.choice([0, 1, 333, 99999]) for x in leaves}
    change = {0: -10001, 50: 777, 3: 12345, leaves[5]: -7, 0.5: 0}
    change.pop(0.5)
    above = {}
    for x in parent:
        at, above[x] = x, []
        while at is not None:
            above[x].append(at)
            at = parent[at]
    share = defaultdict(int)
    for node, cents in change.items():
        mine = [x for x in leaves if node in above[x]]
        total, upto = sum(amount[x] for x in mine), 0
        whole = total or len(mine)
        placed = 0
        for x in mine:
            upto += amount[x] if total else 1
            now = (2 * abs(cents) * upto + whole) // (2 * whole)
            share[x] += (now - placed) * (1 if cents > 0 else -1)
            placed = now
        assert placed == abs(cents)
    def money(cents):
        return f"CAST({cents} / 100.0 AS DECIMAL(18,2))"
    amounts = spark.createDataFrame(list(amount.items()), "node long, cents long").select(
        "node", (F.col("cents").cast("decimal(18,2)") / 100).cast("decimal(18,2)").alias("amount"))
    revisions = spark.createDataFrame(list(change.items()), "node long, cents long").select(
        "node", (F.col("cents").cast("decimal(18,2)") / 100).cast("decimal(18,2)").alias("change"))
    edges = spark.createDataFrame(list(parent.items()), "child long, parent long")
    got = derive.propagate_revision(amounts, edges, revisions).collect()
    want = {}
    for node in {a for x in leaves if x in share for a in above[x]}:
        mine = [x for x in leaves if node in above[x]]
        want[node] = (sum(n in change for n in above[node]), sum(amount[x] for x in mine),
                      sum(amount[x] + share[x] for x in mine))
    assert {r["node"]: (r["n_revisions"], round(r["before"] * 100), round(r["after"] * 100)) for r in got} == want
    assert derive.propagate_revision(amounts.limit(0), edges.limit(0), revisions).collect() == []


@pytest.mark.parametrize("forks, way", [(0, "up"), (12, "down")])
def test_lineage_over_kinds_of_nodes(spark, forks, way):
    """Ids with kinds take the short rounds, the same ids without a colon the general ones."""
    rng = random.Random(forks)
    rows = [(f"B:{i % 7}", f"A:{i}") for i in range(40)] + [(f"A:{rng.randrange(40)}", f"C:{i}") for i in range(90)]
    rows += [(f"C:{i}", f"P:{i}") for i in range(0, 90, 2)] + [("B:1", "A:8"), ("B:8", None), (None, "A:1")]
    rows += [(f"A:{rng.randrange(40)}", f"C:{rng.randrange(90)}") for _ in range(forks)]
    for more in ([], [("P:4", "B:1"), ("A:3", "P:8")]):  # layers, then a cycle of kinds and a way past one
        got = []
        for mark, paths in ((":", True), ("-", False)):
            edges = spark.createDataFrame(rows + more, "src string, dst string").select(
                F.translate("src", ":", mark).alias("src"), F.translate("dst", ":", mark).alias("dst"))
            starts = spark.createDataFrame([(f"{k}{mark}{i}",) for k in "PBX" for i in range(0, 9, 2)] + [(None,)],
                                           "id string")
            out = graph.lineage_paths(graph.lineage_trace(edges, starts, way, paths))
            got.append(sorted(tuple(str(x).replace("-", ":") for x in r) for r in out.select(
                "start", "node", "depth", F.array_join("path", "<")).collect()))
        assert got[0] and got[0] == got[1]


def test_lineage_drops_what_its_rounds_shuffled(spark):
    edges = spark.range(300_000).selectExpr("concat('C:', id) AS src", "concat('P:', id) AS dst").union(
        spark.range(300_000).selectExpr("concat('A:', id div 4)", "concat('C:', id)"))
    starts = spark.range(300_000).selectExpr("concat('P:', id) AS id")
    got = []
    assert left_behind(spark, lambda: got.append(graph.lineage_trace(edges, starts, paths=True))) < 0.5
    assert sorted(tuple(r) for r in got[0].groupBy("depth").count().collect()) == [(1, 300_000), (2, 300_000)]
