"""Event streams. ``ts`` is a timestamp; every operator takes and returns a streaming frame, and
those that need a sink of their own take the folder to write to.

Windows, sessions and deadlines are answered when the watermark passes them. A stream that has come
to its end is closed by a marker (``with_end``, ``close_input``): a row of a later time that moves the
watermark past everything open and itself stays open, so it is in no result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import quarantine
from ..operators.windows import build_scd2
from ..scale import small, windowed

MONEY = "decimal(18,2)"
#: the time of the marker that closes an input for good
END = "9999-01-01 00:00:00"


def with_end(stream: DataFrame, markers: str, **values) -> DataFrame:
    """``stream`` and the closing markers that ``close_input`` writes to the folder ``markers``.

    A marker has a ``ts``, the constants ``values`` that later filters ask for, and nulls.
    """
    spark = stream.sparkSession
    spark.createDataFrame([], "ts timestamp").write.mode("append").parquet(markers)
    ends = spark.readStream.schema("ts timestamp").parquet(markers)
    return stream.unionByName(ends.select("ts", *[F.lit(v).alias(k) for k, v in values.items()]),
                              allowMissingColumns=True)


def close_input(spark: SparkSession, markers: str, at: str = END) -> None:
    """Write the marker. Everything before ``at``, less the delay, is late from then on."""
    spark.range(1).select(F.lit(at).cast("timestamp").alias("ts")).write.mode("append").parquet(markers)


def drain_closed(stream: DataFrame, target: str, checkpoint: str, markers: str) -> None:
    """Drain what is available, then close the input and drain what the end releases."""
    drain(stream, target, checkpoint)
    close_input(stream.sparkSession, markers)
    drain(stream, target, checkpoint)


def tumbling(stream: DataFrame, width: str, delay: str, keys: list[str]) -> DataFrame:
    """Counts and amounts per fixed window."""
    return (stream.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), *keys)
            .agg(F.count(F.lit(1)).alias("n"), F.sum("value").cast(MONEY).alias("amount")))


def sliding(stream: DataFrame, width: str, slide: str, delay: str, keys: list[str]) -> DataFrame:
    """Moving counts for alerts."""
    return (stream.withWatermark("ts", delay)
            .groupBy(F.window("ts", width, slide).alias("w"), *keys)
            .agg(F.count(F.lit(1)).alias("n")))


def sessions(stream: DataFrame, gap: str, delay: str, actor: str) -> DataFrame:
    """Work sessions per actor, closed after ``gap`` without an event."""
    return (stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), actor)
            .agg(F.count(F.lit(1)).alias("n")))


def dedupe(stream: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """Retried events applied once."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def enrich(stream: DataFrame, dims: DataFrame, on: list[str]) -> DataFrame:
    """Reference columns added by a stream–static join."""
    return stream.join(dims, on, "left")


def security(stream: DataFrame, width: str, delay: str, actor: str, threshold: int) -> DataFrame:
    """Actors with an abnormal number of records in a window."""
    return tumbling(stream, width, delay, [actor]).filter(F.col("n") >= threshold)


def unanswered(opened: DataFrame, answers: DataFrame, on: str, within: str, delay: str) -> DataFrame:
    """Opened items without an answer of the same key within the interval after them.

    Items wait in the join state until the watermark passes their deadline; then they leave
    without an answer. ``opened`` keeps all its columns, ``answers`` brings key and ``ts``. An item
    without a key has no answer, and an answer without one answers nothing.
    """
    # keys are never null nor constant: such rows, closing markers too, leave before their time is seen
    def keyed(kind: str) -> Column:
        return F.coalesce(F.concat(F.lit("="), F.col(on).cast("string")),
                          F.concat(F.lit(kind), F.col("ts").cast("string")))

    left = opened.withColumn("_on", keyed("item ")).withWatermark("ts", delay)
    right = answers.select(keyed("answer ").alias("_key"), F.col("ts").alias("answered_at")).withWatermark(
        "answered_at", delay)
    cond = ((F.col("_on") == F.col("_key")) & (F.col("answered_at") >= F.col("ts"))
            & (F.col("answered_at") <= F.col("ts") + F.expr(f"interval {within}")))
    return left.join(right, cond, "left_outer").filter(F.col("answered_at").isNull()).drop(
        "_on", "_key", "answered_at")


def outbox(transactions: DataFrame, events: DataFrame, on: str, within: str, delay: str) -> DataFrame:
    """Committed transactions whose event was not published in time."""
    return unanswered(transactions, events, on, within, delay)


def deadlines(opened: DataFrame, done: DataFrame, on: str, sla: str, delay: str) -> DataFrame:
    """Validations not done by their deadline."""
    return unanswered(opened, done, on, sla, delay)


def drain(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Append what is available to Parquet files, then stop."""
    (stream.writeStream.format("parquet").outputMode("append").option("path", target)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
     .awaitTermination())


def each_batch(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str,
               mode: str = "append") -> None:
    """Run ``step`` on every available micro-batch, then stop. Steps overwrite the folder of their
    batch, so a repeated batch leaves one copy."""
    (stream.writeStream.foreachBatch(step).outputMode(mode)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
     .awaitTermination())


def envelope(stream: DataFrame, key: str, ceilings: DataFrame, target: str, checkpoint: str) -> None:
    """Running use per envelope with remaining credit, and one alert when it first exceeds its ceiling.

    A batch adds its events, in order of time and id, to the totals the last one left, and writes the
    totals of all envelopes (``totals``), a change per envelope it touched (``changes``) and the event
    that took an envelope over its ceiling (``alerts``). An envelope is alerted once, also if credits
    bring it back below the ceiling in between. Running sums are dealt into ranges, so an envelope
    may have most of the events. Events of unknown envelopes have no ceiling and raise no alert.
    """
    kind, ceiling = stream.schema[key].dataType.simpleString(), "decimal(18,2)"
    schema = f"`{key}` {kind}, used {MONEY}, last_ts timestamp, alerted boolean"

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = (spark.read.schema(schema).parquet(f"{target}/totals/batch={batch_id - 1}") if batch_id
                  else spark.createDataFrame([], schema))
        old = before.select(F.col(key).alias("_key"), F.col("used").alias("_used"), "alerted")
        limit = ceilings.select(F.col(key).alias("_of"), F.col("ceiling").cast(ceiling).alias("ceiling"))
        running = windowed(batch.select(key, "event_id", "ts", "value"), [key],
                           [F.col("ts"), F.col("event_id")], _sum=("sum", "value"))
        known = running.join(small(old), F.col(key).eqNullSafe(F.col("_key")), "left").join(
            small(limit), F.col(key).eqNullSafe(F.col("_of")), "left").select(
            key, "event_id", "ts", (F.coalesce("_used", F.lit(0)) + F.col("_sum")).cast(MONEY).alias("used"),
            "ceiling", F.coalesce("alerted", F.lit(False)).alias("alerted"))
        crossing = known.filter(~F.col("alerted") & (F.col("used") > F.col("ceiling")))
        crossing.groupBy(key).agg(F.min(F.struct("ts", "event_id", "used")).alias("first")).select(
            key, "first.event_id", "first.ts", "first.used").write.mode("overwrite").parquet(
            f"{target}/alerts/batch={batch_id}")
        alerts = spark.read.parquet(f"{target}/alerts/batch={batch_id}").select(F.col(key).alias("_key"))
        added = batch.groupBy(key).agg(F.sum("value").alias("used"), F.max("ts").alias("last_ts")).select(
            "*", F.lit(False).alias("alerted"), F.lit(True).alias("_touched"))
        totals = before.withColumn("_touched", F.lit(False)).unionByName(added).groupBy(key).agg(
            F.sum("used").cast(MONEY).alias("used"), F.max("last_ts").alias("last_ts"),
            F.max("alerted").alias("alerted"), F.max("_touched").alias("_touched"))
        totals = totals.join(small(alerts.withColumn("_now", F.lit(True))),
                             F.col(key).eqNullSafe(F.col("_key")), "left").select(
            key, "used", "last_ts", (F.col("alerted") | F.coalesce("_now", F.lit(False))).alias("alerted"),
            "_touched")
        totals.select(key, "used", "last_ts", "alerted").write.mode("overwrite").parquet(
            f"{target}/totals/batch={batch_id}")
        totals.filter("_touched").join(small(limit), F.col(key).eqNullSafe(F.col("_of")), "left").select(
            key, "used", "last_ts", (F.col("ceiling") - F.col("used")).alias("available"),
            (F.col("used") > F.col("ceiling")).alias("over_ceiling")).write.mode("overwrite").parquet(
            f"{target}/changes/batch={batch_id}")

    each_batch(stream, step, checkpoint)


def quarantine_stream(stream: DataFrame, rules: dict[str, Column], target: str, checkpoint: str
                      ) -> None:
    """Valid and invalid rows to two sinks; the invalid keep their reasons."""
    def step(batch: DataFrame, batch_id: int) -> None:
        ok, bad = quarantine(batch, rules)
        ok.write.mode("overwrite").parquet(f"{target}/ok/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{target}/bad/batch={batch_id}")

    each_batch(stream, step, checkpoint)


def label_late(stream: DataFrame, delay: str, target: str, checkpoint: str, only: bool = False) -> None:
    """Keep late rows and say so; with ``only`` keep no others: a side table of what windows over the
    same batches may leave out (they still take late rows of the very next batch). The high-water mark of the earlier batches is stored beside the
    rows, so nothing depends on a watermark that would drop them."""
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = None
        if batch_id > 0:
            marks = spark.read.schema("high timestamp, batch long").parquet(f"{target}/marks")
            mark = marks.filter(F.col("batch") < batch_id).agg(F.max("high")).first()[0]
        late = F.lit(False) if mark is None else (
            F.col("ts") < F.lit(mark) - F.expr(f"interval {delay}"))
        marked = batch.withColumn("late", late)
        (marked.filter("late") if only else marked).write.mode("overwrite").parquet(
            f"{target}/rows/batch={batch_id}")
        batch.agg(F.max("ts").alias("high")).write.mode("overwrite").parquet(
            f"{target}/marks/batch={batch_id}")

    each_batch(stream, step, checkpoint)


def cdc_scd2(stream: DataFrame, key: str, dated: str, ident: str, values: list[str], target: str,
             checkpoint: str, buckets: int = 32) -> None:
    """Continuous versioning. The history lies in ``buckets`` by hash of the key; a batch reads the
    buckets its keys fall into and writes them anew, with a row for each in its list of buckets, and
    the newest writing of a bucket is the valid one (see ``read_scd2``). Buckets that no key of the
    batch falls into are not read."""
    base = [key, dated, ident, *values]
    missing = set(base) - set(stream.columns)
    if missing:
        raise ValueError(f"no columns {sorted(missing)} in the stream")

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        changes = batch.select(*base, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket"))
        touched = sorted(r[0] for r in changes.select("bucket").distinct().collect())
        before = _buckets(spark, target, touched, batch_id)
        if before is not None:
            changes = before.select(*[F.col("valid_from").alias(c) if c == dated else c for c in base],
                                    "bucket").unionByName(changes)
        rows = build_scd2(changes.drop("bucket"), key, dated, ident).withColumn(
            "bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/rows/batch={batch_id}")
        spark.createDataFrame([(b,) for b in touched], "bucket int").coalesce(1).write.mode(
            "overwrite").parquet(f"{target}/buckets/batch={batch_id}")

    each_batch(stream, step, checkpoint)


def _buckets(spark: SparkSession, target: str, wanted: list[int] | None, before: int | None
             ) -> DataFrame | None:
    """The valid rows of the wanted buckets (None: all) as of the batches before one; none if empty."""
    if before == 0:
        return None
    listed = spark.read.schema("bucket int, batch long").parquet(f"{target}/buckets")
    if before is not None:
        listed = listed.filter(F.col("batch") < before)
    newest = listed.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()  # a row per bucket
    paths = [f"{target}/rows/batch={r['batch']}/bucket={r['bucket']}" for r in newest
             if wanted is None or r["bucket"] in set(wanted)]
    if not paths:
        return None
    return spark.read.option("basePath", f"{target}/rows").parquet(*sorted(paths)).drop("batch")


def read_scd2(spark: SparkSession, target: str) -> DataFrame:
    """The valid versions: every bucket as its last batch wrote it."""
    rows = _buckets(spark, target, None, None)
    if rows is None:
        raise ValueError(f"no versions in {target}")
    return rows.drop("bucket")
