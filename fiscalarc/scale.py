"""Helpers that keep jobs even when one group holds a large share of all rows.

``windowed`` computes window functions per group. Large inputs with a group that is too large for one
task are dealt into ranges of (group, order): the window runs inside each range and the totals of the groups that span ranges are carried
over, so the answer is that of the plain window and no task ever sees a whole hot group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .session import cut

SPLIT_MIN_BYTES = "fiscalarc.split.minBytes"
SPLIT_MIN_ROWS = "fiscalarc.split.minRows"


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = 8 << 20) -> DataFrame:
    """Hint a broadcast only if the estimated size is below ``limit``; else let Spark choose."""
    return F.broadcast(df) if plan_bytes(df) <= limit else df


def _conf(df: DataFrame, key: str, default: int) -> int:
    return int(df.sparkSession.conf.get(key, str(default)))


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def _left(df: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    renamed = side.select(*[F.col(c).alias(f"_k_{c}") if c in keys else F.col(c)
                            for c in side.columns])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return df.join(F.broadcast(renamed), cond, "left").drop(*[f"_k_{k}" for k in keys])


#: groups are counted in so many buckets; none is larger than its bucket
BUCKETS = 1 << 16


def _may_be_hot(df: DataFrame, keys: list[str], rows: int) -> bool:
    """Whether a group may have more than ``rows`` rows; the counts are combined map-side."""
    if not keys:
        return True
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("_b")
    most = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"]
    return (most or 0) > rows


def windowed(df: DataFrame, keys: list[str], order: list[Column], **outs: tuple) -> DataFrame:
    """Add window columns per ``keys`` in ``order`` (ascending expressions; negate to reverse).

    Each output is a tuple: ``("row_number",)``, ``("rank",)``, ``("dense_rank",)``,
    ``("size",)``, ``("total", col)`` over the whole group, ``("sum", col)`` and ``("max", col)``
    up to and with the row,
    ``("sum_before", col)``, ``("max_before", col)``, ``("lag", col)``, ``("lead", col)``.
    """
    names = [f"_o{i}" for i in range(len(order))]
    base = df.select("*", *[c.alias(n) for c, n in zip(order, names)])
    rows = _conf(df, SPLIT_MIN_ROWS, 1_000_000)
    # without a large group the tasks of the plain window are small, and nothing is written
    if plan_bytes(base) >= _conf(df, SPLIT_MIN_BYTES, 256 << 20) and _may_be_hot(df, keys, rows):
        # the estimate multiplies over joins: the input is written once and its rows are counted
        base = cut(base)
        total = base.count()
    else:
        total = 0
    if total <= rows:
        w = W.partitionBy(*keys).orderBy(*names)
        return base.select(*df.columns, *[
            _plain(spec, w, W.partitionBy(*keys)).alias(out) for out, spec in outs.items()])

    # rows with equal keys and order stay in one range; the ranges are written, so they never change
    sliced = cut(base.repartitionByRange(total // rows + 1, *keys, *names).withColumn(
        "_slice", F.spark_partition_id()))
    here = F.struct(*names)
    local_keys = [*keys, "_slice"]
    w = W.partitionBy(*local_keys).orderBy(*names)

    sums = [F.count(F.lit(1)).alias("_n"), F.countDistinct(here).alias("_d")]
    for out, spec in outs.items():
        kind, col = spec[0], spec[1] if len(spec) > 1 else None
        if kind in ("sum", "sum_before", "total"):
            sums.append(F.sum(col).alias(f"_s_{out}"))
        elif kind in ("max", "max_before"):
            sums.append(F.max(col).alias(f"_s_{out}"))
        elif kind == "lag":
            sums.append(F.max_by(F.struct(F.col(col)), here).alias(f"_s_{out}"))
        elif kind == "lead":
            sums.append(F.min_by(F.struct(F.col(col)), here).alias(f"_s_{out}"))
    # groups that span ranges: at most two per range
    spanning = sliced.groupBy(*keys).agg(F.min("_slice").alias("_a"), F.max("_slice").alias("_z")) \
        .filter("_a < _z").drop("_a", "_z")
    wide = sliced if not keys else sliced.join(F.broadcast(spanning.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys])), reduce(lambda a, b: a & b, [
            F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]), "left_semi")
    totals = wide.groupBy(*local_keys).agg(*sums)
    across = W.partitionBy(*keys).orderBy("_slice")
    before = across.rowsBetween(W.unboundedPreceding, -1)
    carry = [F.sum("_n").over(before).alias("_c_n"), F.sum("_d").over(before).alias("_c_d"),
             F.sum("_n").over(W.partitionBy(*keys)).alias("_c_size")]
    for out, spec in outs.items():
        source = f"_s_{out}"
        if spec[0] in ("sum", "sum_before"):
            carry.append(F.sum(source).over(before).alias(f"_c_{out}"))
        elif spec[0] == "total":
            carry.append(F.sum(source).over(W.partitionBy(*keys)).alias(f"_c_{out}"))
        elif spec[0] in ("max", "max_before"):
            carry.append(F.max(source).over(before).alias(f"_c_{out}"))
        elif spec[0] == "lag":
            carry.append(F.lag(source).over(across).alias(f"_c_{out}"))
        elif spec[0] == "lead":
            carry.append(F.lead(source).over(across).alias(f"_c_{out}"))
    carried = _left(sliced, totals.select(*local_keys, *carry), local_keys)
    local = carried.withColumn("_first", F.lag(F.lit(1)).over(w).isNull()).withColumn(
        "_last", F.lead(F.lit(1)).over(w).isNull())
    for out, spec in outs.items():
        local = local.withColumn(f"_l_{out}", _plain(spec, w, W.partitionBy(*local_keys)))
    zero = F.lit(0)
    final = []
    for out, spec in outs.items():
        kind, mine, old = spec[0], F.col(f"_l_{out}"), F.col(f"_c_{out}") if len(spec) > 1 else None
        if kind in ("row_number", "rank"):
            value = mine + F.coalesce("_c_n", zero)
        elif kind == "dense_rank":
            value = mine + F.coalesce("_c_d", zero)
        elif kind == "size":
            value = F.coalesce("_c_size", mine)
        elif kind == "total":
            value = F.coalesce(old, mine)
        elif kind in ("sum", "sum_before"):
            value = F.when(old.isNull(), mine).when(mine.isNull(), old).otherwise(old + mine)
        elif kind in ("max", "max_before"):
            value = F.greatest(mine, old)
        elif kind == "lag":
            value = F.when(F.col("_first"), old[spec[1]]).otherwise(mine)
        else:
            value = F.when(F.col("_last"), old[spec[1]]).otherwise(mine)
        final.append(value.alias(out))
    return local.select(*df.columns, *final)


def _plain(spec: tuple, w, whole) -> Column:
    kind = spec[0]
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    if kind in ("row_number", "rank", "dense_rank"):
        return getattr(F, kind)().over(w).cast("long")
    if kind == "size":
        return F.count(F.lit(1)).over(whole)
    column = F.col(spec[1])
    if kind == "total":
        return F.sum(column).over(whole)
    return {
        "sum": lambda: F.sum(column).over(upto),
        "max": lambda: F.max(column).over(upto),
        "sum_before": lambda: F.sum(column).over(before),
        "max_before": lambda: F.max(column).over(before),
        "lag": lambda: F.lag(column).over(w),
        "lead": lambda: F.lead(column).over(w),
    }[kind]()


def percentiles(df: DataFrame, keys: list[str], value: str, **probs: float) -> DataFrame:
    """Exact interpolated percentiles per group from a value histogram.

    The histogram is combined map-side and its running count uses ``windowed``, so a hot group is
    spread over its values instead of being gathered in one aggregation buffer. The last
    aggregation finds the rows already partitioned by the window.
    """
    hist = (df.filter(F.col(value).isNotNull())
            .groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_f")))
    placed = windowed(hist, keys, [F.col(value)], _upto=("sum", "_f"), _all=("total", "_f"))
    start = F.col("_upto") - F.col("_f")
    aggs = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_all") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        low = F.max(F.when((start <= lo) & (lo < F.col("_upto")), F.col(value)))
        high = F.max(F.when((start <= hi) & (hi < F.col("_upto")), F.col(value)))
        part = F.max(pos - lo)
        aggs.append((low.cast("double") + (high.cast("double") - low.cast("double")) * part)
                    .alias(name))
    return placed.groupBy(*keys).agg(*aggs)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int,
                  rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group; Spark prunes to ``k`` per task before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def pick(df: DataFrame, keys: list[str], order: Column, latest: bool = True) -> DataFrame:
    """One whole row per key; Spark prunes to one per key and task before the shuffle."""
    by = order.desc_nulls_last() if latest else order.asc_nulls_last()
    rest = [c for c in df.columns if c not in keys]
    w = W.partitionBy(*keys).orderBy(by)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*keys, *rest)
