"""Queries of the streaming operators: each drains the event stream, then reads its sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import money
from ..session import work_dir
from ..sources.ingest import read_events
from ..streaming import streams as S
from .registry import query


def events(t):
    raw = read_events(t.spark, f"{t.path}/events.parquet")
    return raw.select("event_id", "ts", F.col("user_id").alias("actor"),
                      F.col("event_type").alias("kind"),
                      F.col("value").cast("decimal(18,2)").alias("value"),
                      F.get_json_object("props", "$.k").cast("int").alias("k"))


def drained(t, stream):
    target = work_dir(t.spark, "stream")
    S.drain(stream, target, work_dir(t.spark, "checkpoint"))
    return t.spark.read.schema(stream.schema).parquet(target)


def clock(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def closed(t, build):
    """All rows of ``build(end)`` after the input was closed; ``end`` adds the marker to a stream."""
    target, markers = work_dir(t.spark, "stream"), work_dir(t.spark, "end")
    stream = build(lambda df, **values: S.with_end(df, markers, **values))
    S.drain_closed(stream, target, work_dir(t.spark, "checkpoint"), markers)
    return t.spark.read.schema(stream.schema).parquet(target)


query("stream_tumbling", """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, kind, count(*) AS n,
  CAST(sum(value) AS DOUBLE) AS amount FROM x_ev GROUP BY date_trunc('hour', ts), kind""")(
    lambda t: closed(t, lambda end: S.tumbling(end(events(t)), "1 hour", "10 minutes", ["kind"])).select(
        clock("w.start").alias("start"), "kind", "n", money("amount").alias("amount")))

query("stream_sliding", """
WITH w AS (SELECT time_bucket(INTERVAL 15 MINUTES, ts, TIMESTAMP '1970-01-01') - i * INTERVAL 15 MINUTES
    AS start, kind FROM x_ev, range(4) r(i))
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, kind, count(*) AS n FROM w GROUP BY w.start, kind""")(
    lambda t: closed(t, lambda end: S.sliding(
        end(events(t)), "1 hour", "15 minutes", "10 minutes", ["kind"])).select(
        clock("w.start").alias("start"), "kind", "n"))

query("stream_sessions", """
WITH f AS (SELECT actor, ts, CAST(lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTES
    AS INT) AS new FROM x_ev WINDOW w AS (PARTITION BY actor ORDER BY ts)),
g AS (SELECT *, sum(new) OVER (PARTITION BY actor ORDER BY ts) AS s FROM f)
SELECT actor, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM g GROUP BY actor, s""")(
    lambda t: closed(t, lambda end: S.sessions(end(events(t)), "30 minutes", "10 minutes", "actor")).select(
        "actor", clock("w.start").alias("start"), "n"))

query("stream_dedupe", """
SELECT kind, count(*) AS n, CAST(sum(value) AS DOUBLE) AS amount FROM x_ev GROUP BY 1""")(
    lambda t: drained(t, S.dedupe(events(t).unionByName(events(t)), ["event_id"], "40 days"))
    .groupBy("kind").agg(F.count(F.lit(1)).alias("n"), money(F.sum("value")).alias("amount")))


@query("stream_envelope", """
WITH c AS (SELECT kind, round(sum(value) * CASE WHEN kind IN ('click', 'view') THEN CAST(0.9 AS DECIMAL(2,1))
    ELSE CAST(1.1 AS DECIMAL(2,1)) END, 2) AS ceiling FROM x_ev GROUP BY kind),
r AS (SELECT kind, event_id, ts, sum(value) OVER (PARTITION BY kind ORDER BY ts, event_id) AS used FROM x_ev),
f AS (SELECT kind, arg_min(event_id, (ts, event_id)) AS crossed_by FROM r JOIN c USING (kind)
  WHERE used > ceiling GROUP BY kind)
SELECT kind, CAST(sum(value) AS DOUBLE) AS used, CAST(ceiling - sum(value) AS DOUBLE) AS available,
  sum(value) > ceiling AS over_ceiling, crossed_by
FROM x_ev JOIN c USING (kind) LEFT JOIN f USING (kind) GROUP BY kind, ceiling, crossed_by""")
def _(t):
    share = F.when(F.col("kind").isin("click", "view"), F.lit("0.9").cast("decimal(2,1)")).otherwise(
        F.lit("1.1").cast("decimal(2,1)"))
    ceilings = t.event.groupBy("kind").agg(F.sum("value").alias("_s")).select(
        "kind", F.round(F.col("_s") * share, 2).cast("decimal(18,2)").alias("ceiling"))
    target = work_dir(t.spark, "envelope")
    S.envelope(events(t), "kind", ceilings, target, work_dir(t.spark, "checkpoint"))
    last = t.spark.read.parquet(f"{target}/changes").groupBy("kind").agg(F.max_by(
        F.struct("used", "available", "over_ceiling"), "batch").alias("r"))
    alerts = t.spark.read.parquet(f"{target}/alerts").select(
        F.col("kind").alias("_kind"), F.col("event_id").alias("crossed_by"))
    return last.join(alerts, F.col("kind").eqNullSafe(F.col("_kind")), "left").select(
        "kind", money("r.used").alias("used"), money("r.available").alias("available"),
        "r.over_ceiling", "crossed_by")


query("stream_enrich", """
SELECT event_id, n_name AS commune, r_name AS department FROM x_ev
JOIN nation ON n_nationkey = actor % 25 JOIN region ON r_regionkey = n_regionkey""")(
    lambda t: drained(t, S.enrich(
        events(t).withColumn("place", (F.col("actor") % 25).cast("int")),
        t.ministry.select(F.col("ministry_id").alias("place"), F.col("ministry").alias("commune"),
                          F.col("institution").alias("department")), ["place"]))
    .select("event_id", "commune", "department"))


def _unanswered(t, fn, opened, answered, span):
    def side(end, kind):
        return end(events(t).filter(F.col("kind") == kind))

    return closed(t, lambda end: fn(side(end, opened), side(end, answered), "actor", span, "10 minutes")
                  ).select("event_id", "actor")


def _unanswered_sql(opened, answered, interval):
    return f"""
SELECT event_id, actor FROM x_ev o WHERE kind = '{opened}' AND NOT EXISTS (SELECT 1 FROM x_ev a
  WHERE a.kind = '{answered}' AND a.actor = o.actor AND a.ts >= o.ts AND a.ts <= o.ts + INTERVAL {interval})"""


query("stream_outbox", _unanswered_sql("purchase", "click", "1 HOUR"))(
    lambda t: _unanswered(t, S.outbox, "purchase", "click", "1 hour"))

query("stream_deadlines", _unanswered_sql("signup", "purchase", "2 DAYS"))(
    lambda t: _unanswered(t, S.deadlines, "signup", "purchase", "2 days"))


@query("stream_cdc_scd2", """
SELECT actor, event_id, row_number() OVER w AS version, lag(event_id) OVER w AS supersedes_id, kind
FROM x_ev WINDOW w AS (PARTITION BY actor ORDER BY ts, event_id)""")
def _(t):
    target = work_dir(t.spark, "scd2")
    S.cdc_scd2(events(t), "actor", "ts", "event_id", ["kind"], target,
               work_dir(t.spark, "checkpoint"))
    return S.read_scd2(t.spark, target).select("actor", "event_id", "version",
                                                        "supersedes_id", "kind")


@query("stream_quarantine", """
SELECT event_id, concat_ws(',', CASE WHEN value > 40 THEN 'value too high' END,
  CASE WHEN k < 5 THEN 'k too low' END) AS reasons FROM x_ev WHERE value > 40 OR k < 5
UNION ALL SELECT event_id, 'ok' FROM x_ev WHERE NOT (value > 40 OR k < 5)""")
def _(t):
    target = work_dir(t.spark, "quarantine")
    S.quarantine_stream(events(t), {"value too high": F.col("value") > 40,
                                    "k too low": F.col("k") < 5}, target,
                        work_dir(t.spark, "checkpoint"))
    ok = t.spark.read.parquet(f"{target}/ok").select("event_id", F.lit("ok").alias("reasons"))
    bad = t.spark.read.parquet(f"{target}/bad").select(
        "event_id", F.array_join("reasons", ",").alias("reasons"))
    return bad.unionByName(ok)


@query("stream_late", """
SELECT event_id, ts < TIMESTAMP '2024-01-16' AND ts < (SELECT max(ts) FROM x_ev) - INTERVAL 10 MINUTES
  AS late FROM x_ev""")
def _(t):
    # the newer half arrives first, the older half follows after an offline period
    source, target = work_dir(t.spark, "feed"), work_dir(t.spark, "late")
    checkpoint, raw = work_dir(t.spark, "checkpoint"), t.raw("events")
    split = F.lit("2024-01-16").cast("timestamp_ntz")
    for half in (F.col("ts") >= split, F.col("ts") < split):
        raw.filter(half).write.mode("append").parquet(source)
        S.label_late(read_events(t.spark, source), "10 minutes", target, checkpoint)
    return t.spark.read.parquet(f"{target}/rows").select("event_id", "late")


query("stream_security", """
SELECT actor, strftime(CAST(day AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM x_ev
GROUP BY actor, day HAVING count(*) >= 5""")(
    lambda t: closed(t, lambda end: S.security(end(events(t)), "1 day", "10 minutes", "actor", 5)).select(
        "actor", clock("w.start").alias("start"), "n"))
