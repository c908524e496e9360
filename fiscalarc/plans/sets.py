"""Queries of set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import day
from ..operators import aggregates as A
from ..operators import sets as S
from ..operators import windows as W
from ..sources import rules as R
from .ingestion import second_version
from .inputs import indicator_results, milestones, risks
from .registry import VIEWS, query

VIEWS["x_signal"] = f"""
  SELECT signal_type, program, object_id, CAST(p AS INT) AS probability, CAST(i AS INT) AS impact FROM (
  SELECT 'PLANNING' AS signal_type, program, CAST(activity_id AS VARCHAR) AS object_id, 3 AS p, 3 AS i
    FROM x_au WHERE activity_id NOT IN (SELECT activity_id FROM x_line)
  UNION ALL SELECT 'BUDGET', program, program || ':' || fiscal_year, 5, 4 FROM x_env
    WHERE need > available
  UNION ALL SELECT 'PROCUREMENT', program, CAST(activity_id AS VARCHAR), 4, 4 FROM x_au
    WHERE execution_mode <> 'DIRECT' AND status = 'IN_PREPARATION'
      AND start_date BETWEEN DATE '{R.TODAY}' AND DATE '{R.TODAY}' + 20
  UNION ALL SELECT 'CONTRACT', program, contract_number, 4, 2 + CAST(n_lines > 1 AS INT)
    FROM x_contract JOIN x_au USING (activity_id)
    WHERE status = 'IN_EXECUTION' AND end_date < DATE '{R.TODAY}'
  UNION ALL SELECT 'PHYSICAL', program, CAST(activity_id AS VARCHAR), 3, 5 FROM (
      SELECT program, activity_id, coalesce(sum(weight) FILTER (done), 0) AS d, sum(weight) AS w
      FROM x_mile GROUP BY ALL) WHERE d * 10 < w
  UNION ALL SELECT 'INDICATOR', program, indicator || ':' || week, 2, 4 FROM x_ires WHERE NOT reached
  UNION ALL SELECT 'RISK', NULL, CAST(event_id AS VARCHAR), 1 + actor % 5, 1 + k % 5 FROM x_ev
    WHERE (1 + actor % 5) * (1 + k % 5) >= 20)"""


def signal_table(t):
    """Signals of all seven origins at the reporting date."""
    au, today = t.activity_unit, F.lit(R.TODAY).cast("date")
    key = F.concat_ws(":", "program", "fiscal_year")
    progress = A.physical_progress(milestones(t), ["program", "activity_id"])
    behind = W.performance_gap(indicator_results(t))
    contracts = t.contract.join(au.select("activity_id", "program", "status"), "activity_id")
    n = F.lit
    return S.early_warnings([
        S.signals(au.join(t.line.select("activity_id").distinct(), "activity_id", "left_anti"),
                  "PLANNING", n(True), "program", "activity_id", n(3), n(3)),
        S.signals(t.envelope, "BUDGET", F.col("need") > F.col("available"), "program", key, n(5),
                  n(4)),
        S.signals(au, "PROCUREMENT", (F.col("execution_mode") != "DIRECT")
                  & (F.col("status") == "IN_PREPARATION")
                  & F.col("start_date").between(today, F.date_add(today, 20)),
                  "program", "activity_id", n(4), n(4)),
        S.signals(contracts, "CONTRACT", (F.col("status") == "IN_EXECUTION")
                  & (F.col("end_date") < today), "program", "contract_number", n(4),
                  2 + (F.col("n_lines") > 1).cast("int")),
        S.signals(progress, "PHYSICAL", F.col("done_weight") * 10 < F.col("total_weight"),
                  "program", "activity_id", n(3), n(5)),
        S.signals(behind, "INDICATOR", F.col("behind"), "program",
                  F.concat_ws(":", "indicator", "week"), n(2), n(4)),
        S.signals(risks(t), "RISK", F.col("probability") * F.col("impact") >= 20,
                  F.lit(None).cast("string"), "event_id", F.col("probability"), F.col("impact"))])


query("early_warnings", """
SELECT signal_type, program, object_id, probability, impact, CASE WHEN probability * impact >= 15
  THEN 'CRITICAL' WHEN probability * impact >= 8 THEN 'WARNING' ELSE 'INFO' END AS severity,
  'OPEN' AS status FROM x_signal""")(signal_table)


@query("master_schedule", """
WITH s AS (SELECT budget_activity_id, 'Studies' AS phase, start_date AS a, start_date AS b FROM x_act
    WHERE execution_mode = 'DIRECT'
  UNION ALL SELECT budget_activity_id, 'Procurement', start_date, start_date FROM x_act
    WHERE execution_mode <> 'DIRECT'
  UNION ALL SELECT budget_activity_id, 'Contracts', signature_date, end_date
    FROM x_contract JOIN x_act USING (activity_id)
  UNION ALL SELECT budget_activity_id, 'Works', work_date, work_date FROM x_la WHERE line_status = 'O'
  UNION ALL SELECT budget_activity_id, 'Payments', pay_date, pay_date
    FROM x_pay JOIN x_act USING (activity_id))
SELECT budget_activity_id, phase, CAST(min(a) AS VARCHAR) AS first_date,
  CAST(max(b) AS VARCHAR) AS last_date, count(*) AS n_items FROM s GROUP BY ALL""")
def _(t):
    act = t.activity.select("activity_id", "budget_activity_id", "start_date", "execution_mode")
    def span(df, a, b):
        return df.withColumn("_a", F.col(a)).withColumn("_b", F.col(b)).select(
            "budget_activity_id", F.col("_a").alias("start_date"), F.col("_b").alias("end_date"))
    direct = F.col("execution_mode") == "DIRECT"
    owner = act.select("activity_id", "budget_activity_id")
    out = S.master_schedule({
        "Studies": span(act.filter(direct), "start_date", "start_date"),
        "Procurement": span(act.filter(~direct), "start_date", "start_date"),
        "Contracts": span(t.contract.join(owner, "activity_id"), "signature_date", "end_date"),
        "Works": span(t.line.filter("line_status = 'O'").join(owner, "activity_id"), "work_date",
                      "work_date"),
        "Payments": span(t.payment.join(owner, "activity_id"), "pay_date", "pay_date"),
    }, "budget_activity_id")
    return out.withColumn("first_date", day("first_date")).withColumn("last_date", day("last_date"))


query("missing_in_target", """
SELECT activity_id FROM x_act EXCEPT ALL SELECT activity_id FROM x_act2""")(
    lambda t: S.missing_in_target(t.activity, second_version(t), ["activity_id"]))


@query("common_needs", """
SELECT resource_id, strftime(work_date, '%Y-%m') AS month FROM x_need WHERE institution_id = 0
INTERSECT SELECT resource_id, strftime(work_date, '%Y-%m') FROM x_need WHERE institution_id = 1""")
def _(t):
    needs = t.need.withColumn("month", F.date_format("work_date", "yyyy-MM"))
    return S.common_needs(needs.filter("institution_id = 0"), needs.filter("institution_id = 1"),
                          ["resource_id", "month"])


query("dedupe_documents", """
SELECT sha256(text) AS hash, min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY 1""")(
    lambda t: S.dedupe_documents(t.document, "doc_id", "text"))

query("idempotent_actions", """
SELECT actor, kind, k, min(event_id) AS event_id, CAST(arg_min(value, event_id) AS DOUBLE) AS value
FROM x_ev GROUP BY actor, kind, k""")(
    lambda t: S.idempotent_actions(
        t.event.select("actor", "kind", "k", "event_id", F.col("value").cast("double").alias("value")),
        ["actor", "kind", "k"], "event_id"))


@query("global_search_index", """
SELECT DISTINCT 'program' AS kind, program AS id, program AS label, program AS text FROM x_unit
UNION ALL SELECT 'activity', CAST(activity_id AS VARCHAR), 'Activity ' || activity_id,
  status || ' ' || execution_mode || ' ' || priority FROM x_act
UNION ALL SELECT 'contract', contract_number, 'Contract ' || contract_number,
  'Supplier ' || supplier_id FROM x_contract
UNION ALL SELECT 'project', CAST(unit_id AS VARCHAR), unit_name, program || ' ' || institution FROM x_unit
UNION ALL SELECT 'document', CAST(doc_id AS VARCHAR), lang || ' ' || source, text FROM documents
UNION ALL SELECT DISTINCT 'indicator', indicator, label, coalesce(definition, '') FROM x_indicator
  WHERE indicator IN (SELECT kind FROM x_ev)""")
def _(t):
    def part(df, ident, label, text):
        return df.select(ident.alias("id"), label.alias("label"), text.alias("text"))
    c, cat = F.col, F.concat_ws
    unit = t.unit
    used = t.event.select(c("kind").alias("indicator")).distinct().join(t.rule("indicator"),
                                                                       "indicator")
    return S.global_search_index({
        "program": part(unit.select("program").distinct(), c("program"), c("program"), c("program")),
        "activity": part(t.activity, c("activity_id"), cat(" ", F.lit("Activity"), "activity_id"),
                         cat(" ", "status", "execution_mode", "priority")),
        "contract": part(t.contract, c("contract_number"),
                         cat(" ", F.lit("Contract"), "contract_number"),
                         cat(" ", F.lit("Supplier"), "supplier_id")),
        "project": part(unit, c("unit_id"), c("unit_name"), cat(" ", "program", "institution")),
        "document": part(t.document, c("doc_id"), cat(" ", "lang", "source"), c("text")),
        "indicator": part(used, c("indicator"), c("label"), F.coalesce("definition", F.lit("")))})
