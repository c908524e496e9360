"""Queries of the window operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import day, money
from ..operators import aggregates as A
from ..operators import windows as W
from ..sources import rules as R
from .ingestion import history
from .inputs import ai_runs, indicator_results, offers, projects
from .registry import VIEWS, query

query("build_scd2", """
SELECT object_id, activity_id, version, supersedes_id, CAST(valid_from AS VARCHAR) AS valid_from,
  CAST(valid_to AS VARCHAR) AS valid_to FROM x_hist""")(
    lambda t: history(t).select("object_id", "activity_id", "version", "supersedes_id",
                                day("valid_from").alias("valid_from"),
                                day("valid_to").alias("valid_to")))

query("validity_gaps", """
WITH v AS (SELECT budget_activity_id AS object_id, activity_id, start_date AS valid_from,
    CAST(start_date + 90 AS DATE) AS valid_to, lead(start_date) OVER (PARTITION BY budget_activity_id
      ORDER BY start_date, activity_id) AS nxt FROM x_act)
SELECT object_id, activity_id, CAST(date_diff('day', valid_to, nxt) AS INT) AS days,
  CASE WHEN nxt > valid_to THEN 'GAP' ELSE 'OVERLAP' END AS issue
FROM v WHERE nxt IS NOT NULL AND nxt <> valid_to""")(
    lambda t: W.validity_gaps(t.activity.select(
        F.col("budget_activity_id").alias("object_id"), "activity_id",
        F.col("start_date").alias("valid_from"), F.date_add("start_date", 90).alias("valid_to")),
        "object_id", "activity_id").select("object_id", "activity_id", "days", "issue"))

query("latest_version", """
SELECT budget_activity_id AS object_id, activity_id, status FROM x_act WHERE status <> 'IN_PREPARATION'
QUALIFY row_number() OVER (PARTITION BY budget_activity_id ORDER BY start_date DESC, activity_id DESC)
  = 1""")(
    lambda t: W.latest_version(
        t.activity.select(F.col("budget_activity_id").alias("object_id"), "activity_id", "status",
                          "start_date"), "object_id", ["start_date", "activity_id"],
        F.col("status") != "IN_PREPARATION").select("object_id", "activity_id", "status"))


@query("cash_forecast", """
WITH m AS (SELECT program, strftime(pay_date, '%Y-%m') AS month, sum(amount) AS amount
  FROM x_pay JOIN x_au USING (activity_id) WHERE NOT rejected GROUP BY ALL),
c AS (SELECT program, sum(allocation) AS credit FROM x_au GROUP BY 1)
SELECT program, month, CAST(sum(amount) OVER w AS DOUBLE) AS cumulative,
  CAST(credit - sum(amount) OVER w AS DOUBLE) AS remaining FROM m JOIN c USING (program)
WINDOW w AS (PARTITION BY program ORDER BY month)""")
def _(t):
    au = t.activity_unit
    monthly = A.pcc_monthly(
        t.payment.filter(~F.col("rejected")).join(au.select("activity_id", "program"), "activity_id")
        .select("program", F.col("pay_date").alias("period"),
                F.col("amount").alias("planned_amount")), ["program"])
    credit = au.groupBy("program").agg(F.sum("allocation").cast("decimal(18,2)").alias("credit"))
    return W.cash_forecast(monthly, credit, "program").select(
        "program", "month", money("cumulative").alias("cumulative"),
        money("remaining").alias("remaining"))


VIEWS["x_anom"] = f"""
  SELECT l.activity_id, l.seq, l.resource_id, l.unit_cents, m.median,
    CAST(l.unit_cents - p.ref_cents AS DOUBLE) / p.ref_cents AS gap
  FROM x_line l JOIN (SELECT resource_id, quantile_cont(unit_cents, 0.5) AS median FROM x_line
    GROUP BY 1) m USING (resource_id)
  JOIN (SELECT resource_id, quantile_cont(abs(2 * unit_cents - CAST(2 * median AS BIGINT)), 0.5) AS mad2
    FROM x_line JOIN (SELECT resource_id, quantile_cont(unit_cents, 0.5) AS median FROM x_line
      GROUP BY 1) USING (resource_id) GROUP BY 1) d USING (resource_id)
  JOIN x_price p USING (resource_id)
  WHERE abs(2 * l.unit_cents - CAST(2 * m.median AS BIGINT)) > {R.MAD_FACTOR} * d.mad2"""


def anomalies(t):
    return W.price_anomalies(
        t.line.select("activity_id", "seq", "resource_id", "unit_cents"),
        t.price.select("resource_id", "ref_cents"), R.PRICE_GAP_LIMIT, R.MAD_FACTOR)


query("price_anomalies", """
SELECT activity_id, seq, resource_id, unit_cents, median, gap, gap > 0.2 AS justify FROM x_anom""")(
    lambda t: anomalies(t).select("activity_id", "seq", "resource_id", "unit_cents", "median",
                                  "gap", "justify"))


@query("anti_splitting", f"""
WITH d AS (SELECT budget_activity_id, category, work_date, sum(total) AS s, count(*) AS n FROM x_need
  WHERE total < {R.SPLITTING_LIMIT} GROUP BY ALL),
w AS (SELECT budget_activity_id, category, work_date,
  sum(s) OVER w AS window_total, CAST(sum(n) OVER w AS BIGINT) AS n_needs FROM d
  WINDOW w AS (PARTITION BY budget_activity_id, category ORDER BY work_date
    RANGE BETWEEN INTERVAL {R.SPLITTING_DAYS} DAYS PRECEDING AND CURRENT ROW))
SELECT budget_activity_id, category, CAST(work_date AS VARCHAR) AS work_date,
  CAST(window_total AS DOUBLE) AS window_total, n_needs FROM w
WHERE window_total >= {R.SPLITTING_LIMIT} AND n_needs > 1""")
def _(t):
    return W.anti_splitting(t.need, ["budget_activity_id", "category"], R.SPLITTING_LIMIT,
                            R.SPLITTING_DAYS).select(
        "budget_activity_id", "category", day("work_date").alias("work_date"),
        money("window_total").alias("window_total"), "n_needs")


query("price_level_rank", """
WITH b AS (SELECT resource_id, supplier_id, min(unit_cents) AS unit_cents FROM x_line GROUP BY ALL)
SELECT resource_id, supplier_id, unit_cents,
  percent_rank() OVER (PARTITION BY resource_id ORDER BY unit_cents) AS percent_rank,
  CAST(ntile(10) OVER (PARTITION BY resource_id ORDER BY unit_cents, supplier_id) AS INT) AS decile
FROM b""")(lambda t: W.price_level_rank(t.line, "resource_id", "supplier_id", "unit_cents"))

query("prioritise_projects", """
SELECT project_id, institution, rank FROM (SELECT project_id, institution, row_number() OVER
  (PARTITION BY institution ORDER BY mandatory DESC, score DESC, project_id) AS rank FROM x_project)""")(
    lambda t: W.prioritise_projects(projects(t), "institution", F.col("score"), "project_id")
    .select("project_id", "institution", "rank"))


@query("indicator_trend", """
WITH s AS (SELECT kind AS indicator, day, CAST(sum(value) AS DOUBLE) / count(*) AS v FROM x_ev
  GROUP BY ALL)
SELECT indicator, CAST(day AS VARCHAR) AS period, v AS value, v - lag(v) OVER w AS change,
  round(avg(v) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving_mean FROM s
WINDOW w AS (PARTITION BY indicator ORDER BY day)""")
def _(t):
    series = t.event.groupBy(F.col("kind").alias("indicator"), "day").agg(
        (F.sum("value").cast("double") / F.count(F.lit(1))).alias("value"))
    return W.indicator_trend(series, "indicator", "day", "value").select(
        "indicator", day("day").alias("period"), "value", "change",
        F.round("moving_mean", 6).alias("moving_mean"))


@query("target_trajectory", """
WITH r AS (SELECT x.*, i.baseline FROM x_ires x JOIN x_indicator i USING (indicator))
SELECT indicator, week, baseline, actual, round(baseline + (last_value(target) OVER w - baseline)
  * (CAST(week - min(week) OVER w + 1 AS DOUBLE) / (max(week) OVER w - min(week) OVER w + 1)), 6)
  AS trajectory FROM r WINDOW w AS (PARTITION BY indicator ORDER BY week ROWS BETWEEN
  UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def _(t):
    results = indicator_results(t).join(t.rule("indicator").select("indicator", "baseline"),
                                        "indicator")
    return W.target_trajectory(results, "indicator", "week").withColumn(
        "trajectory", F.round("trajectory", 6))


query("performance_gap", """
SELECT indicator, week, CASE direction WHEN 'LOWER' THEN target - actual ELSE actual - target END AS gap,
  CASE direction WHEN 'LOWER' THEN target - actual ELSE actual - target END < 0 AS behind
FROM x_ires""")(
    lambda t: W.performance_gap(indicator_results(t)).select("indicator", "week", "gap", "behind"))


@query("forecast_indicator", """
WITH s AS (SELECT kind AS indicator, CAST(day - DATE '2020-01-01' AS DOUBLE) AS x, CAST(sum(value) AS DOUBLE) / count(*)
  AS y FROM x_ev GROUP BY ALL)
SELECT indicator, count(*) AS n_points, round(regr_slope(y, x), 6) AS slope, max(x) + 7 AS period,
  round(regr_intercept(y, x) + regr_slope(y, x) * (max(x) + 7), 4) AS forecast, 'FORECAST' AS label
FROM s GROUP BY 1""")
def _(t):
    series = t.event.groupBy(F.col("kind").alias("indicator"),
                             F.date_diff("day", F.lit("2020-01-01").cast("date")).cast("double").alias("x")).agg(
        (F.sum("value").cast("double") / F.count(F.lit(1))).alias("y"))
    return W.forecast_indicator(series, ["indicator"], "x", "y", 7)


query("recurrent_activities", """
WITH y AS (SELECT budget_activity_id, execution_mode, fiscal_year, count(*) AS n,
    sum(allocation) AS a, fiscal_year - row_number() OVER (PARTITION BY budget_activity_id,
      execution_mode ORDER BY fiscal_year) AS island FROM x_act GROUP BY ALL)
SELECT budget_activity_id, execution_mode, min(fiscal_year) AS first_year, max(fiscal_year) AS last_year,
  CAST(sum(n) AS BIGINT) AS n_activities, CAST(sum(a) AS DOUBLE) AS amount FROM y
GROUP BY budget_activity_id, execution_mode, island HAVING max(fiscal_year) - min(fiscal_year) >= 1
""".replace("FROM x_act GROUP BY ALL)", "FROM (SELECT budget_activity_id, execution_mode, fiscal_year, "
            "count(*) AS n0, sum(allocation) AS a0 FROM x_act GROUP BY ALL))").replace(
    "count(*) AS n,\n    sum(allocation) AS a,", "n0 AS n, a0 AS a,"))(
    lambda t: W.recurrent_activities(t.activity, ["budget_activity_id", "execution_mode"],
                                     "fiscal_year").withColumn("amount", money("amount")))

VIEWS["x_seqline"] = """
  SELECT l.*, start_date, program, execution_mode, status, row_number() OVER (
    PARTITION BY activity_id ORDER BY seq, resource_id, supplier_id, quantity, total, discount, tax,
      return_flag, line_status, work_date) AS pos FROM x_lu l"""

FULL_ORDER = ["seq", "resource_id", "supplier_id", "quantity", "total", "discount", "tax",
              "return_flag", "line_status", "work_date"]


@query("deadline_status", f"""
WITH d AS (SELECT activity_id, pos, CAST(start_date + CAST(30 * seq AS INT) AS DATE) AS deadline,
  line_status = 'F' AS done FROM x_seqline)
SELECT activity_id, pos, CAST(date_diff('day', DATE '{R.TODAY}', deadline) AS INT) AS days_left,
  NOT done AND deadline < DATE '{R.TODAY}' AS late,
  NOT done AND coalesce(bool_or(NOT done AND deadline < DATE '{R.TODAY}') OVER (PARTITION BY activity_id
    ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS at_risk FROM d""")
def _(t):
    from ..scale import windowed
    tasks = windowed(t.line_activity, ["activity_id"], [F.col(c) for c in FULL_ORDER],
                     pos=("row_number",)).select(
        "activity_id", "pos", F.date_add("start_date", F.col("seq") * 30).alias("deadline"),
        (F.col("line_status") == "F").alias("done"))
    return W.deadline_status(tasks, R.TODAY, ["activity_id"], [F.col("pos")]).select(
        "activity_id", "pos", "days_left", "late", "at_risk")


query("audit_changes", """
SELECT budget_activity_id, activity_id, status, CAST(allocation AS DOUBLE) AS allocation,
  lag(status) OVER w AS status_before, CAST(lag(allocation) OVER w AS DOUBLE) AS allocation_before
FROM x_act WINDOW w AS (PARTITION BY budget_activity_id ORDER BY start_date, activity_id)""")(
    lambda t: W.audit_changes(
        t.activity.select("budget_activity_id", "activity_id", "start_date", "status", "allocation"),
        "budget_activity_id", [F.col("start_date"), F.col("activity_id")],
        ["status", "allocation"]).select(
        "budget_activity_id", "activity_id", "status", money("allocation").alias("allocation"),
        "status_before", money("allocation_before").alias("allocation_before")))


@query("verify_audit_chain", """
WITH b AS (SELECT *, row_number() OVER w AS pos, lead(event_id) OVER w AS nxt,
    lag(event_id) OVER w AS prv FROM x_ev WINDOW w AS (PARTITION BY actor ORDER BY event_id)),
k AS (SELECT *, k = 7 AS removed, k = 3 AS tampered FROM b),
p AS (SELECT *, lag(removed) OVER (PARTITION BY actor ORDER BY event_id) AS prev_removed FROM k)
SELECT event_id, actor, tampered AS altered, coalesce(prev_removed, FALSE) AS predecessor_missing
FROM p WHERE NOT removed AND (tampered OR coalesce(prev_removed, FALSE))""")
def _(t):
    order = [F.col("event_id")]
    content = F.concat_ws("|", "event_id", "actor", "kind", "value")
    sealed = W.chain_hashes(t.event, "actor", order, content)
    # damage done after sealing: records removed (k = 7) and amounts changed (k = 3)
    damaged = sealed.filter("k <> 7").withColumn("value", F.when(
        F.col("k") == 3, (F.col("value") + 1).cast("decimal(18,2)")).otherwise(F.col("value")))
    return W.verify_audit_chain(damaged, "actor", order, content).select(
        "event_id", "actor", "altered", "predecessor_missing")


query("repeat_runs", """
WITH b AS (SELECT event_id, actor, kind, k % 2 AS tool, row_number() OVER (PARTITION BY actor
    ORDER BY event_id) - row_number() OVER (PARTITION BY actor, kind, k % 2 ORDER BY event_id) AS g
  FROM x_ev)
SELECT actor, kind, tool, count(*) AS n_calls, min(event_id) AS first_event,
  max(event_id) AS last_event FROM b GROUP BY actor, kind, tool, g HAVING count(*) >= 3""")(
    lambda t: W.repeat_runs(
        t.event.select("event_id", "actor", "kind", (F.col("k") % 2).alias("tool")), "actor",
        [F.col("event_id")], ["kind", "tool"], 3))


@query("budget_exceeded_runs", """
WITH r AS (SELECT actor, day, event_id, row_number() OVER w AS step, sum(value) OVER
  (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spent FROM x_ev
  WINDOW w AS (PARTITION BY actor, day ORDER BY event_id))
SELECT actor, CAST(day AS VARCHAR) AS day, event_id, step, CAST(spent AS DOUBLE) AS spent,
  CASE WHEN step > 4 THEN 'steps' ELSE 'cost' END AS reason FROM r WHERE step > 4 OR spent > 100
QUALIFY row_number() OVER (PARTITION BY actor, day ORDER BY step) = 1""")
def _(t):
    runs = t.event.select("actor", "day", "event_id", F.col("value").alias("cost"))
    return W.budget_exceeded_runs(runs, ["actor", "day"], [F.col("event_id")], 4, "100").select(
        "actor", F.col("day").cast("string").alias("day"), "event_id", "step",
        money("spent").alias("spent"), "reason")


VIEWS["x_moves"] = """
  SELECT event_id, actor, state AS to_state, lag(state) OVER w AS from_state, ts,
    epoch_us(ts) - epoch_us(lag(ts) OVER w) AS micros FROM x_ev JOIN x_state_map USING (kind)
  WINDOW w AS (PARTITION BY actor ORDER BY event_id)"""

query("state_transitions", """
SELECT event_id, actor, m.from_state, m.to_state, micros, a.from_state IS NOT NULL AS legal FROM x_moves m
LEFT JOIN x_allowed_transition a ON a.from_state = m.from_state AND a.to_state = m.to_state
WHERE m.from_state <> m.to_state""")(
    lambda t: W.state_transitions(
        t.event.join(t.rule("state_map"), "kind").select("event_id", "actor", "ts", "state"),
        "actor", [F.col("event_id")], "state", "ts", t.rule("allowed_transition")).select(
        "event_id", "actor", "from_state", "to_state", "micros", "legal"))

query("lifecycle_funnel", f"""
WITH s AS (SELECT CAST(unnest(range(0, stage + 1)) AS INT) AS stage_no FROM x_project)
SELECT stage_no, [{', '.join(f"'{s}'" for s in R.INVESTMENT_STAGES)}][stage_no + 1] AS stage,
  count(*) AS n_reached, CAST(count(*) AS DOUBLE) / lag(count(*)) OVER (ORDER BY stage_no) AS conversion
FROM s GROUP BY stage_no""")(lambda t: W.lifecycle_funnel(projects(t), R.INVESTMENT_STAGES))
