"""Sorts, limits, top-k and portfolio selection."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate
from tempfile import TemporaryFile

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import small, top_per_group, windowed
from ..session import cut

CENTS = "decimal(38,0)"


def timeline(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Steps numbered in time order; partitioned by key and sorted inside, never one global sort."""
    return windowed(steps, keys, [F.col("step_date"), F.col("step"), F.col("ref")],
                    step_no=("row_number",)).sortWithinPartitions(*keys, "step_no")


def top_alerts(signals: DataFrame, k: int, group: str = "program") -> DataFrame:
    """The k most severe signals per program."""
    score = F.col("probability") * F.col("impact")
    return top_per_group(signals.withColumn("score", score), [group],
                         [F.desc("score"), F.col("signal_type"), F.col("object_id")], k)


def top_anomalies(anomalies: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """The k largest gaps overall: each task keeps k rows, then one merge."""
    return anomalies.orderBy(*order).limit(k)


def work_queue(parts: list[DataFrame], role: str, k: int) -> DataFrame:
    """Actions, validations, deadlines and alerts of one role, most urgent first."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return (out.filter(F.col("role") == role)
            .orderBy("due", F.desc("weight"), "item", "object_id").limit(k))


def notifications(signals: DataFrame, routes: DataFrame) -> DataFrame:
    """One message per signal type, object, channel and recipient, the most severe signal kept."""
    routed = signals.join(small(routes), "signal_type")
    return routed.groupBy("signal_type", "program", "object_id", "channel", "recipient_role").agg(
        F.max(F.col("probability") * F.col("impact")).alias("score"))


def select_pip(ranked: DataFrame, ceilings: DataFrame, portfolio: str) -> DataFrame:
    """Projects in rank order while their cumulative cost fits; a project that does not fit
    stops its portfolio. ``optimise_portfolio`` gives the best set instead."""
    run = windowed(ranked, [portfolio], [F.col("rank")], cumulative=("sum", "total_cost"))
    return run.join(small(ceilings), portfolio).filter(
        F.col("cumulative") <= F.col("ceiling"))


def _start(values: list[int], costs: list[int], room: int, nodes: int = 200_000) -> list[bool]:
    """A good subset to start from: depth-first search on ratio order for so many steps."""
    order = sorted(range(len(values)), key=lambda i: (-values[i] / costs[i], i))
    v, c, n = [values[i] for i in order], [costs[i] for i in order], len(order)
    sum_v, sum_c = [0, *accumulate(v)], [0, *accumulate(c)]
    best, best_path = -1, None
    stack = [(0, room, 0, None)]  # next item, room left, value so far, linked list of taken items
    while stack and nodes:
        i, left, got, path = stack.pop()
        nodes -= 1
        if got > best:
            best, best_path = got, path
        j = bisect_right(sum_c, sum_c[i] + left) - 1  # items i..j-1 fit whole
        bound = got + sum_v[j] - sum_v[i]
        if j < n:
            bound += v[j] * (left - (sum_c[j] - sum_c[i])) // c[j]
        if i >= n or bound <= best:
            continue
        stack.append((i + 1, left, got, path))
        if c[i] <= left:
            stack.append((i + 1, left - c[i], got + v[i], (i, path)))
    taken = [False] * n
    while best_path is not None:
        taken[order[best_path[0]]] = True
        best_path = best_path[1]
    return taken


def _best(values: list[int], costs: list[int], room: int) -> list[bool]:
    """Best subset, exact: a dynamic programme over (cost, value) from the break point outwards.

    Items are decided in turn from the break point of the ratio order to its ends. A state is
    dropped only if another costs no more and is worth as much, or if its linear bound cannot pass
    the best set known, so there are never more states than distinct costs. The step each state
    came by goes to a temporary file, from which the best set is read back.
    """
    order = sorted(range(len(values)), key=lambda i: (-values[i] / costs[i], i))
    v, c, n = [values[i] for i in order], [costs[i] for i in order], len(order)
    ratio = [a / b for a, b in zip(v, c)]
    taken, b, used, best = [False] * n, 0, 0, 0
    while b < n and used + c[b] <= room:
        used, best, b = used + c[b], best + v[b], b + 1
    kind = np.int64 if max(sum(v), sum(c), room) < 2 ** 62 else object
    cost, value = np.array([used], kind), np.array([best], kind)
    left, right, steps, found = b - 1, b, [], None
    with TemporaryFile() as log:
        def open_states() -> np.ndarray:
            """States that may lead to more than the best: linear bound over the items left."""
            low = ratio[right] if right < n else 0.0
            high = ratio[left] if left >= 0 else np.inf
            over = (cost - room).astype(float)
            gain = np.zeros(len(cost))
            gain[over < 0] = -over[over < 0] * low
            gain[over > 0] = -over[over > 0] * high
            bound = value.astype(float) + gain
            return bound * (1 + 1e-12 * np.sign(bound)) + 1e-6 >= best + 1

        alive = open_states()
        cost, value = cost[alive], value[alive]
        at = 0
        while len(cost) and (right < n or left >= 0):
            add = right < n and (left < 0 or right - b <= b - 1 - left)
            item, sign = (right, 1) if add else (left, -1)
            right, left = right + add, left - (not add)
            size = len(cost)
            both = np.concatenate([cost, cost + sign * c[item]])
            worth = np.concatenate([value, value + sign * v[item]])
            come = np.arange(2 * size)
            come = np.where(come < size, 2 * come, 2 * (come - size) + 1)  # 2 * state before + flipped
            sort = np.argsort(both, kind="stable")
            both, worth, come = both[sort], worth[sort], come[sort]
            keep = np.ones(len(both), bool)
            keep[1:] = worth[1:] > np.maximum.accumulate(worth)[:-1]
            keep[np.flatnonzero(keep)[:-1]] &= np.diff(both[keep]) > 0
            cost, value, come = both[keep], worth[keep], come[keep]
            fits = int(np.searchsorted(cost, room, "right"))
            if fits and value[fits - 1] > best:  # values rise with costs
                best, found = int(value[fits - 1]), (len(steps), int(come[fits - 1]))
            alive = open_states()
            cost, value, come = cost[alive], value[alive], come[alive]
            steps.append((item, at))
            log.write(come.astype(np.int64).tobytes())
            at += 8 * len(come)
        taken[:b] = [True] * b
        while found:
            step, code = found
            item, _ = steps[step]
            taken[item] ^= bool(code & 1)
            if not step:
                break
            log.seek(steps[step - 1][1] + 8 * (code >> 1))
            found = step - 1, int(np.frombuffer(log.read(8), np.int64)[0])
    out = [False] * n
    for i, t in zip(order, taken):
        out[i] = t
    return out


def optimise_portfolio(projects: DataFrame, ceilings: DataFrame, portfolio: str, ident: str,
                       near: int = 60) -> DataFrame:
    """Best project set under each portfolio's ceiling, mandatory projects forced in.

    Ranking by value per cost is a distributed running sum. A search among the ``near`` projects
    on each side of the break point gives a first set. The bound of the linear relaxation then
    fixes every project that cannot be part of a change to a better set, whatever the first one
    was; all others, the core, are solved exactly, in one task per portfolio. ``proven`` is
    always true.
    """
    p, out_schema = portfolio, "_id long, _take boolean"
    cents = projects.select(
        F.col(p).alias("_g"), F.col(ident).alias("_id"), "mandatory",
        (F.col("total_cost") * 100).cast("long").alias("_c"),
        (F.col("score") * 100).cast("long").alias("_v"))
    room = ceilings.select(F.col(p).alias("_g"), (F.col("ceiling") * 100).cast(CENTS).alias("_room"))
    forced = cents.filter("mandatory").groupBy("_g").agg(F.sum("_c").cast(CENTS).alias("_f"))
    space = room.join(forced, "_g", "left").select(
        "_g", F.greatest(F.col("_room") - F.coalesce("_f", F.lit(0)), F.lit(0)).cast(CENTS)
        .alias("_r"))
    free = cents.filter((~F.col("mandatory")) & (F.col("_c") <= 0) & (F.col("_v") > 0))
    items = cents.filter((~F.col("mandatory")) & (F.col("_c") > 0) & (F.col("_v") > 0))
    ratio = F.col("_v").cast("double") / F.col("_c")
    ranked = windowed(items, ["_g"], [-ratio, F.col("_id")], _cum=("sum", "_c"),
                      _n=("row_number",)).join(space, "_g")
    inside = F.col("_cum") <= F.col("_r")
    marks = ranked.groupBy("_g").agg(
        F.count_if(inside).alias("_b"),
        F.sum(F.when(inside, F.col("_v")).otherwise(0)).cast("double").alias("_pv"),
        F.sum(F.when(inside, F.col("_c")).otherwise(0)).cast("double").alias("_pc"),
        F.coalesce(F.max(F.when(~inside, ratio)), F.lit(0.0)).alias("_l"))
    # each stage feeds several later ones: it is written once instead of being solved again
    placed = cut(ranked.join(marks, "_g").withColumn(
        "_in", F.col("_n") <= F.col("_b")))

    def solve(rows: DataFrame, how) -> DataFrame:
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            take = how([int(x) for x in pdf["_v"]], [int(x) for x in pdf["_c"]],
                       int(pdf["_left"].iloc[0]))
            return pd.DataFrame({"_id": pdf["_id"], "_take": take})
        return rows.groupBy("_g").applyInPandas(one, out_schema)

    def with_room(rows: DataFrame, chosen: Column) -> DataFrame:
        """Room left for the open rows once the fixed rows are in."""
        used = rows.groupBy("_g").agg(F.sum(F.when(chosen & F.col("_in"), F.col("_c"))
                                            .otherwise(0)).cast(CENTS).alias("_u"))
        return rows.join(used, "_g").withColumn(
            "_left", (F.col("_r") - F.col("_u")).cast("string"))

    close = F.abs(F.col("_n") - F.col("_b") - 0.5) <= near
    local = with_room(placed, ~close)
    first = cut(local.join(solve(local.filter(close), _start)
                           .select("_id", F.col("_take").alias("_t1")), "_id", "left")
                .withColumn("_s1", F.coalesce("_t1", "_in")))
    lower = first.groupBy("_g").agg(
        F.sum(F.when(F.col("_s1"), F.col("_v")).otherwise(0)).cast("double").alias("_lb"))
    upper = F.col("_pv") + (F.col("_r").cast("double") - F.col("_pc")) * F.col("_l")
    loss = F.abs(F.col("_v") - F.col("_l") * F.col("_c"))
    # values are whole: a better set is worth at least one more; the rest allows for rounding
    bounded = first.join(lower, "_g").drop("_u", "_left").withColumn(
        "_open", loss <= upper - F.col("_lb") - 1 + 1e-6 + 1e-12 * upper)
    ready = with_room(bounded, ~F.col("_open"))
    second = cut(ready.join(solve(ready.filter("_open"), _best), "_id", "left").withColumn(
        "_s2", F.coalesce("_take", "_in")))
    verdict = second.groupBy("_g").agg(
        F.sum(F.when(F.col("_s2"), F.col("_v")).otherwise(0)).alias("_v2"),
        F.sum(F.when(F.col("_s1"), F.col("_v")).otherwise(0)).alias("_v1"))
    final = second.join(verdict, "_g").filter(
        F.when(F.col("_v2") >= F.col("_v1"), F.col("_s2")).otherwise(F.col("_s1")))
    chosen = (final.select("_id")
              .unionByName(cents.filter("mandatory").select("_id"))
              .unionByName(free.select("_id")))
    return projects.join(chosen.select(F.col("_id").alias(ident), F.lit(True).alias("proven")), ident)
