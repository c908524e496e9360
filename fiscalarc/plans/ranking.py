"""Queries of sorts, limits and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import day, money
from ..operators import ranking as K
from ..operators import windows as W
from ..sources import rules as R
from .inputs import projects
from .registry import VIEWS, query
from .sets import signal_table
from .windowing import anomalies


def ceilings(t):
    """40 % of the cost of all projects of the institution."""
    return projects(t).groupBy("institution").agg(F.round(
        F.sum("total_cost") * F.lit("0.4").cast("decimal(2,1)"), 2).cast("decimal(18,2)")
        .alias("ceiling"))


@query("timeline", """
WITH s AS (SELECT budget_activity_id, start_date AS step_date, 'launch' AS step,
    CAST(activity_id AS VARCHAR) AS ref FROM x_act
  UNION ALL SELECT budget_activity_id, signature_date, 'signature', contract_number
    FROM x_contract JOIN x_act USING (activity_id)
  UNION ALL SELECT budget_activity_id, end_date, 'completion', contract_number
    FROM x_contract JOIN x_act USING (activity_id))
SELECT budget_activity_id, CAST(step_date AS VARCHAR) AS step_date, step, ref, row_number() OVER
  (PARTITION BY budget_activity_id ORDER BY step_date, step, ref) AS step_no FROM s""")
def _(t):
    act = t.activity
    c = t.contract.join(act.select("activity_id", "budget_activity_id"), "activity_id")
    steps = (act.select("budget_activity_id", F.col("start_date").alias("step_date"),
                        F.lit("launch").alias("step"), F.col("activity_id").cast("string").alias("ref"))
             .unionByName(c.select("budget_activity_id", F.col("signature_date").alias("step_date"),
                                   F.lit("signature").alias("step"),
                                   F.col("contract_number").alias("ref")))
             .unionByName(c.select("budget_activity_id", F.col("end_date").alias("step_date"),
                                   F.lit("completion").alias("step"),
                                   F.col("contract_number").alias("ref"))))
    return K.timeline(steps, ["budget_activity_id"]).withColumn("step_date", day("step_date"))


query("top_alerts", """
SELECT program, signal_type, object_id, probability * impact AS score, rank FROM (SELECT *, row_number()
  OVER (PARTITION BY program ORDER BY probability * impact DESC, signal_type, object_id) AS rank
  FROM x_signal) WHERE rank <= 10""")(
    lambda t: K.top_alerts(signal_table(t), 10).select("program", "signal_type", "object_id", "score",
                                                       "rank"))

query("top_anomalies", """
SELECT activity_id, seq, resource_id, gap FROM x_anom
ORDER BY gap DESC, activity_id, seq, resource_id LIMIT 50""")(
    lambda t: K.top_anomalies(anomalies(t), 50, [
        F.desc("gap"), F.col("activity_id"), F.col("seq"), F.col("resource_id")]).select(
        "activity_id", "seq", "resource_id", "gap"))


@query("work_queue", f"""
WITH q AS (SELECT 'validation' AS item, CAST(activity_id AS VARCHAR) AS object_id,
    CAST(start_date AS VARCHAR) AS due, 2 AS weight, CASE WHEN priority = '1-URGENT' THEN 'DPAF' ELSE 'RPRO'
    END AS role FROM x_act WHERE status = 'IN_PREPARATION'
  UNION ALL SELECT 'deadline', contract_number, CAST(end_date AS VARCHAR), 1, 'PRMP' FROM x_contract
    WHERE end_date >= DATE '{R.TODAY}'
  UNION ALL SELECT 'alert', object_id, '{R.TODAY}', probability * impact, recipient_role
    FROM x_signal JOIN x_route USING (signal_type))
SELECT item, object_id, due, CAST(weight AS INT) AS weight FROM q WHERE role = 'DPAF'
ORDER BY due, weight DESC, item, object_id LIMIT 100""")
def _(t):
    def part(df, item, ident, due, weight, role):
        return df.select(F.lit(item).alias("item"), F.col(ident).cast("string").alias("object_id"),
                         due.alias("due"), weight.cast("int").alias("weight"), role.alias("role"))
    parts = [
        part(t.activity.filter("status = 'IN_PREPARATION'"), "validation", "activity_id",
             day("start_date"), F.lit(2),
             F.when(F.col("priority") == "1-URGENT", "DPAF").otherwise("RPRO")),
        part(t.contract.filter(F.col("end_date") >= F.lit(R.TODAY).cast("date")), "deadline",
             "contract_number", day("end_date"), F.lit(1), F.lit("PRMP")),
        part(signal_table(t).join(t.rule("route"), "signal_type"), "alert", "object_id",
             F.lit(R.TODAY), F.col("probability") * F.col("impact"), F.col("recipient_role"))]
    return K.work_queue(parts, "DPAF", 100).select("item", "object_id", "due", "weight")


query("notifications", """
SELECT signal_type, program, object_id, channel, recipient_role, max(probability * impact) AS score
FROM x_signal JOIN x_route USING (signal_type) GROUP BY ALL""")(
    lambda t: K.notifications(signal_table(t), t.rule("route")))

VIEWS["x_ceil"] = """
  SELECT institution, CAST(round(sum(total_cost) * CAST(0.4 AS DECIMAL(2,1)), 2) AS DECIMAL(18,2))
    AS ceiling FROM x_project GROUP BY 1"""


@query("select_pip", """
WITH r AS (SELECT project_id, institution, total_cost, row_number() OVER (PARTITION BY institution
    ORDER BY mandatory DESC, score DESC, project_id) AS rank FROM x_project),
c AS (SELECT *, sum(total_cost) OVER (PARTITION BY institution ORDER BY rank) AS cumulative FROM r)
SELECT project_id, institution, rank, CAST(cumulative AS DOUBLE) AS cumulative
FROM c JOIN x_ceil USING (institution) WHERE cumulative <= ceiling""")
def _(t):
    ranked = W.prioritise_projects(projects(t), "institution", F.col("score"), "project_id")
    return K.select_pip(ranked, ceilings(t), "institution").select(
        "project_id", "institution", "rank", money("cumulative").alias("cumulative"))


@query("optimise_portfolio")
def _(t):
    return K.optimise_portfolio(projects(t), ceilings(t), "institution", "project_id").select(
        "institution", "project_id", "mandatory", money("total_cost").alias("total_cost"),
        money("score").alias("score"), "proven")
