"""Queries of the joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import day, money
from ..operators import aggregates as A
from ..operators import joins as J
from ..sources import rules as R
from .ingestion import second_version
from .inputs import milestones, price_points
from .registry import VIEWS, query


@query("canonical_chain", """
WITH p AS (SELECT activity_id, supplier_id, sum(amount) AS paid FROM x_pay WHERE NOT rejected
  GROUP BY ALL)
SELECT program, a.activity_id, c.contract_number, c.n_lines AS n_tasks,
  CAST(c.award_amount AS DOUBLE) AS cost, CAST(c.award_amount AS DOUBLE) AS award_amount,
  CAST(paid AS DOUBLE) AS paid
FROM x_au a LEFT JOIN x_contract c ON c.activity_id = a.activity_id
LEFT JOIN p ON p.activity_id = c.activity_id AND p.supplier_id = c.supplier_id""")
def _(t):
    out = J.canonical_chain(t.activity_unit, t.line, t.contract.drop("n_lines"), t.payment)
    return out.select("program", "activity_id", "contract_number", "n_tasks",
                      money("cost").alias("cost"), money("award_amount").alias("award_amount"),
                      money("paid").alias("paid"))


query("classify_lines", """
SELECT activity_id, seq, ministry AS administrative, program AS programmatic,
  resource_type AS economic, brand AS functional, institution AS geographic, priority AS funding
FROM x_lu JOIN x_price USING (resource_id)""")(
    lambda t: J.classify_lines(
        t.line_activity, t.unit.select(F.col("unit_id").alias("budget_activity_id"),
                                       F.col("ministry").alias("administrative"),
                                       F.col("program").alias("programmatic"),
                                       F.col("institution").alias("geographic")),
        t.price.select("resource_id", F.col("resource_type").alias("economic"),
                       F.col("brand").alias("functional")))
    .select("activity_id", "seq", "administrative", "programmatic", "economic", "functional",
            "geographic", F.col("priority").alias("funding")))

query("price_as_of", """
WITH p AS (SELECT resource_id, work_date AS observed, min(unit_cents) AS reference_cents FROM x_line
  GROUP BY ALL)
SELECT l.activity_id, l.seq, l.resource_id, l.unit_cents, CAST(p.observed AS VARCHAR) AS observed,
  p.reference_cents
FROM x_line l ASOF LEFT JOIN p ON l.resource_id = p.resource_id AND l.work_date > p.observed""")(
    lambda t: J.price_as_of(
        t.line.select("activity_id", "seq", "resource_id", "unit_cents", "work_date"),
        t.line.select("resource_id", F.col("unit_cents").alias("cents"),
                      F.col("work_date").alias("observed")))
    .select("activity_id", "seq", "resource_id", "unit_cents",
            day("as_of_observed").alias("observed"), "reference_cents"))


@query("price_overrides", """
WITH c AS (SELECT resource_id, source, cents, observed FROM x_points
  UNION ALL SELECT resource_id, 'OFFICIAL', ref_cents, DATE '1995-01-01' FROM x_price
    WHERE brand = 'Brand#1')
SELECT resource_id, source, cents FROM c JOIN x_source_precedence USING (source)
QUALIFY row_number() OVER (PARTITION BY resource_id ORDER BY precedence, observed DESC, cents) = 1""")
def _(t):
    official = t.price.filter("brand = 'Brand#1'").select(
        "resource_id", F.lit("OFFICIAL").alias("source"), F.col("ref_cents").alias("cents"),
        F.lit("1995-01-01").cast("date").alias("observed"))
    return J.price_overrides(price_points(t).unionByName(official), t.rule("source_precedence"),
                             "resource_id")


query("procedure_for_need", """
SELECT n.activity_id, n.seq, n.resource_id, n.category, procedure, control_authority, legal_source
FROM x_need n JOIN x_threshold r ON n.category = r.category AND n.authority_type = r.authority_type
  AND n.regime = r.regime AND n.total >= lower_bound
  AND (upper_bound IS NULL OR n.total < upper_bound)
  AND n.start_date >= valid_from AND (valid_to IS NULL OR n.start_date < valid_to)""")(
    lambda t: J.procedure_for_need(t.need, t.rule("threshold"), "total", "start_date").select(
        "activity_id", "seq", "resource_id", "category", "procedure", "control_authority",
        "legal_source"))

VIEWS["x_role"] = """
  SELECT role, valid_from, lead(valid_from) OVER (PARTITION BY role ORDER BY valid_from) AS valid_to,
    person_id FROM (SELECT ministry_id AS role, start_date AS valid_from,
      arg_max(budget_activity_id, activity_id) AS person_id FROM x_au GROUP BY ALL)"""


def role_assignments(t):
    """A new activity of the ministry makes its unit the role holder; the last of a day counts."""
    from ..scale import windowed
    last = t.activity_unit.groupBy(F.col("ministry_id").alias("role"),
                                   F.col("start_date").alias("valid_from")).agg(
        F.max_by("budget_activity_id", "activity_id").alias("person_id"))
    return windowed(last, ["role"], [F.col("valid_from")], valid_to=("lead", "valid_from"))


@query("role_holder_at", """
SELECT p.activity_id, p.seq, p.role, CAST(p.pay_date AS VARCHAR) AS pay_date, r.person_id
FROM (SELECT x.activity_id, seq, ministry_id AS role, pay_date FROM x_pay x
  JOIN x_au USING (activity_id)) p
ASOF LEFT JOIN x_role r ON p.role = r.role AND p.pay_date >= r.valid_from""")
def _(t):
    pay = t.payment.join(t.activity_unit.select("activity_id", F.col("ministry_id").alias("role")),
                         "activity_id").select("activity_id", "seq", "role", "pay_date")
    return J.role_holder_at(pay, role_assignments(t), "role", "pay_date").select(
        "activity_id", "seq", "role", day("pay_date").alias("pay_date"), "person_id")


query("sod_violations", """
SELECT actor AS object_id, k AS person, CAST(bool_or(step = 'PREPARE') AS INT) AS prepare,
  CAST(bool_or(step = 'CHECK') AS INT) AS "check", CAST(bool_or(step = 'APPROVE') AS INT) AS approve
FROM x_ev JOIN x_state_map USING (kind) GROUP BY ALL
HAVING bool_or(step = 'PREPARE')::INT + bool_or(step = 'CHECK')::INT + bool_or(step = 'APPROVE')::INT
  >= 2""")(
    lambda t: J.sod_violations(
        t.event.join(t.rule("state_map"), "kind").select(
            F.col("actor").alias("object_id"), F.col("k").alias("person"), "step"),
        "object_id", "person", "step"))

query("assignment_overlaps", """
SELECT activity_id, role, CAST(valid_from AS VARCHAR) AS valid_from,
  CAST(busy_until AS VARCHAR) AS busy_until FROM (
  SELECT activity_id, ministry_id AS role, start_date AS valid_from,
    max(CAST(start_date + 2 AS DATE)) OVER (PARTITION BY ministry_id
      ORDER BY start_date, activity_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
      AS busy_until FROM x_au) WHERE busy_until > valid_from""")(
    lambda t: J.assignment_overlaps(
        t.activity_unit.select("activity_id", F.col("ministry_id").alias("role"),
                               F.col("start_date").alias("valid_from"),
                               F.date_add("start_date", 2).alias("valid_to")),
        "role", "activity_id").select("activity_id", "role", day("valid_from").alias("valid_from"),
                                      day("busy_until").alias("busy_until")))


@query("gap_detection", """
SELECT 'objective_without_programming' AS gap, CAST(unit_id AS VARCHAR) AS id FROM x_unit
  WHERE unit_id NOT IN (SELECT budget_activity_id FROM x_act WHERE fiscal_year = 2001)
UNION ALL SELECT 'activity_not_aligned', CAST(activity_id AS VARCHAR) FROM x_act
  WHERE activity_id % 4 = 0
UNION ALL SELECT DISTINCT 'program_without_indicator', program FROM x_unit
  WHERE program NOT IN (SELECT program FROM x_indicator)
UNION ALL SELECT DISTINCT 'priority_without_funding', budget_activity_id || '/' || priority FROM x_act a
  WHERE NOT EXISTS (SELECT 1 FROM x_act b WHERE b.budget_activity_id = a.budget_activity_id
    AND b.priority = a.priority AND b.status <> 'IN_PREPARATION')""")
def _(t):
    act = t.activity
    wish = F.concat_ws("/", "budget_activity_id", "priority").alias("id")
    return J.gap_detection(
        t.unit.select(F.col("unit_id").alias("id")),
        act.select(F.col("activity_id").alias("id"),
                   F.when(F.col("fiscal_year") == 2001, F.col("budget_activity_id"))
                   .alias("objective")),
        act.filter(F.col("activity_id") % 4 != 0).select(F.col("activity_id").alias("id")),
        t.unit.select(F.col("program").alias("id")).distinct(),
        t.rule("indicator").select(F.col("program").alias("id")),
        act.select(wish).distinct(),
        act.filter("status <> 'IN_PREPARATION'").select(wish))


@query("compliance_check", """
WITH e AS (SELECT activity_id, supplier_id, bool_or(line_status = 'F') AS c,
    bool_or(return_flag = 'N') AS d FROM x_line GROUP BY ALL),
r AS (SELECT contract_number, status <> 'IN_PREPARATION' AS plan_approved,
  execution_mode <> 'DIRECT' OR n_lines = 1 AS procedure_coherent, e.c AS control_done,
  e.d AS documents_present, date_diff('day', start_date, end_date) <= 365 AS deadlines_met,
  award_amount <= allocation AS approved
  FROM x_contract JOIN x_act USING (activity_id) JOIN e USING (activity_id, supplier_id))
SELECT *, plan_approved AND procedure_coherent AND control_done AND documents_present
  AND deadlines_met AND approved AS compliant FROM r""")
def _(t):
    evidence = t.line.select("activity_id", "supplier_id",
                             (F.col("line_status") == "F").alias("paid"),
                             (F.col("return_flag") == "N").alias("documented"))
    return J.compliance_check(t.contract, t.activity, evidence)


_PIECES = ", ".join(f"'{p}'" for p in R.AUDIT_PIECES)

query("audit_pack", f"""
WITH f AS (SELECT DISTINCT activity_id || ':' || supplier_id AS contract_number,
    seq + CASE WHEN line_status = 'F' THEN 4 ELSE 0 END AS n FROM x_line),
a AS (SELECT contract_number, list(n) AS ns FROM f GROUP BY 1)
SELECT contract_number,
  array_to_string(list_filter([{_PIECES}], lambda p, i: list_contains(ns, i)), ',') AS present,
  array_to_string(list_filter([{_PIECES}], lambda p, i: NOT list_contains(ns, i)), ',') AS missing,
  CAST(11 - len(ns) AS INT) AS n_missing FROM a""")(
    lambda t: J.audit_pack(t.line.select(
        F.concat_ws(":", "activity_id", "supplier_id").alias("contract_number"),
        (F.col("seq") + F.when(F.col("line_status") == "F", 4).otherwise(0)).alias("piece_no")),
        "contract_number", R.AUDIT_PIECES))

query("locked_clause_check", """
SELECT d.doc_id, d.source, o.doc_id AS official_id, sha256(d.text) AS hash FROM documents d
JOIN documents o ON o.source = d.source
WHERE o.doc_id = (SELECT min(doc_id) FROM documents m WHERE m.source = d.source)
  AND d.doc_id <> o.doc_id AND d.text <> o.text""")(
    lambda t: J.locked_clause_check(t.document, "source", "doc_id", "text"))

query("cost_reconcile", """
SELECT a.activity_id, CAST(allocation AS DOUBLE) AS planned,
  CAST(coalesce(c.contracted, 0) AS DOUBLE) AS contracted, CAST(coalesce(p.paid, 0) AS DOUBLE) AS paid,
  contracted IS NULL AS no_contract, paid IS NULL AS no_payment
FROM x_act a LEFT JOIN (SELECT activity_id, sum(award_amount) AS contracted FROM x_contract GROUP BY 1) c
  USING (activity_id)
LEFT JOIN (SELECT activity_id, sum(amount) AS paid FROM x_pay WHERE NOT rejected GROUP BY 1) p
  USING (activity_id)""")(
    lambda t: J.cost_reconcile(t.activity, t.contract, t.payment, "activity_id").select(
        "activity_id", *[money(c).alias(c) for c in ("planned", "contracted", "paid")],
        "no_contract", "no_payment"))


@query("planned_vs_actual", """
WITH p AS (SELECT activity_id, min(planned_date) AS planned_date, sum(weight) AS q FROM x_mile
  GROUP BY 1),
d AS (SELECT activity_id, min(work_date) AS actual_date, sum(quantity) AS q, sum(total) AS c
  FROM x_line WHERE line_status = 'F' GROUP BY 1)
SELECT a.activity_id, CAST(date_diff('day', planned_date, actual_date) AS INT) AS delay_days,
  CAST(coalesce(d.q, 0) - coalesce(p.q, 0) AS BIGINT) AS quantity_gap,
  CAST(coalesce(d.c, 0) - allocation AS DOUBLE) AS cost_gap
FROM x_act a LEFT JOIN p USING (activity_id) LEFT JOIN d USING (activity_id)""")
def _(t):
    tasks = milestones(t).groupBy("activity_id").agg(
        F.min("planned_date").alias("planned_date"), F.sum("weight").alias("planned_quantity"))
    plan = t.activity.select("activity_id", F.col("allocation").alias("planned_cost")).join(
        tasks, "activity_id", "left")
    actual = t.line.filter("line_status = 'F'").groupBy("activity_id").agg(
        F.min("work_date").alias("actual_date"), F.sum("quantity").alias("actual_quantity"),
        F.sum("total").cast("decimal(18,2)").alias("actual_cost"))
    return J.planned_vs_actual(plan, actual, "activity_id").select(
        "activity_id", "delay_days", "quantity_gap", money("cost_gap").alias("cost_gap"))


@query("plan_diff", """
SELECT coalesce(o.activity_id, n.activity_id) AS activity_id,
  CASE WHEN o.activity_id IS NULL THEN 'added' WHEN n.activity_id IS NULL THEN 'removed'
    ELSE concat_ws(',', CASE WHEN o.allocation <> n.allocation THEN 'amount' END,
      CASE WHEN o.start_date <> n.start_date THEN 'period' END) END AS change,
  CAST(o.allocation AS DOUBLE) AS old_allocation, CAST(n.allocation AS DOUBLE) AS new_allocation
FROM x_act o FULL JOIN x_act2 n ON o.activity_id = n.activity_id
WHERE o.activity_id IS NULL OR n.activity_id IS NULL OR o.allocation <> n.allocation
  OR o.start_date <> n.start_date""")
def _(t):
    old = t.activity.withColumn("task", F.col("execution_mode"))
    new = second_version(t).withColumn("task", F.col("execution_mode"))
    return J.plan_diff(old, new, ["activity_id"]).select(
        "activity_id", "change", money("old_allocation").alias("old_allocation"),
        money("new_allocation").alias("new_allocation"))


_BANDS = "CASE WHEN {a} < 100000 THEN 'QUOTATION' WHEN {a} < 300000 THEN 'RESTRICTED_TENDER' " \
         "ELSE 'OPEN_TENDER' END"


@query("ppm_diff", f"""
WITH o AS (SELECT activity_id, allocation AS a, start_date AS s FROM x_act
  WHERE execution_mode <> 'DIRECT'),
n AS (SELECT activity_id, allocation AS a, start_date AS s FROM x_act2
  WHERE (CASE WHEN activity_id >= 10000000 THEN activity_id - 10000000 ELSE activity_id END) % 3 <> 0)
SELECT coalesce(o.activity_id, n.activity_id) AS activity_id,
  CASE WHEN o.activity_id IS NULL THEN 'added' WHEN n.activity_id IS NULL THEN 'removed'
    ELSE concat_ws(',', CASE WHEN o.a <> n.a THEN 'amount' END, CASE WHEN o.s <> n.s THEN 'calendar' END,
      CASE WHEN {_BANDS.format(a='o.a')} <> {_BANDS.format(a='n.a')} THEN 'procedure' END) END AS change,
  {_BANDS.format(a='n.a')} AS new_procedure_raw
FROM o FULL JOIN n ON o.activity_id = n.activity_id
WHERE o.activity_id IS NULL OR n.activity_id IS NULL OR o.a <> n.a OR o.s <> n.s""".replace(
    f"{_BANDS.format(a='n.a')} AS new_procedure_raw",
    f"CASE WHEN n.a IS NOT NULL THEN {_BANDS.format(a='n.a')} END AS new_procedure"))
def _(t):
    def plan(df):
        amount = F.col("allocation")
        return df.filter("execution_mode <> 'DIRECT'").select(
            "activity_id", amount.alias("estimated_amount"), F.col("start_date").alias("launch_date"),
            F.when(amount < 100000, "QUOTATION").when(amount < 300000, "RESTRICTED_TENDER")
            .otherwise("OPEN_TENDER").alias("procedure"))
    return J.ppm_diff(plan(t.activity), plan(second_version(t)), ["activity_id"]).select(
        "activity_id", "change", "new_procedure")


@query("physical_financial_matrix", """
WITH p AS (SELECT activity_id, CAST(coalesce(sum(weight) FILTER (done), 0) AS DOUBLE) / sum(weight) AS x,
    CASE WHEN bool_or(return_flag = 'R') THEN 'FAILED' WHEN bool_and(done) THEN 'RECEIVED'
      ELSE 'ONGOING' END AS procurement FROM x_mile GROUP BY 1),
f AS (SELECT activity_id, CAST(coalesce(paid, 0) AS DOUBLE) / CAST(allocation AS DOUBLE) AS y
  FROM x_act LEFT JOIN (SELECT activity_id, sum(amount) AS paid FROM x_pay WHERE NOT rejected
    GROUP BY 1) USING (activity_id))
SELECT CASE WHEN x < 1/3 THEN 'LOW' WHEN x < 2/3 THEN 'MEDIUM' ELSE 'HIGH' END AS physical, procurement,
  count(*) FILTER (y < 1/3) AS financial_low, count(*) FILTER (y >= 1/3 AND y < 2/3)
    AS financial_medium, count(*) FILTER (y >= 2/3) AS financial_high
FROM p JOIN f USING (activity_id) GROUP BY ALL""")
def _(t):
    m = milestones(t)
    physical = A.physical_progress(m, ["activity_id"])
    financial = A.financial_progress(t.payment, t.activity, ["activity_id"])
    status = m.groupBy("activity_id").agg(
        F.when(F.bool_or(F.col("return_flag") == "R"), "FAILED")
        .when(F.bool_and("done"), "RECEIVED").otherwise("ONGOING").alias("procurement"))
    return J.physical_financial_matrix(physical, financial, status, "activity_id")


@query("config_overlay", """
WITH s AS (SELECT DISTINCT institution_id, program FROM x_unit)
SELECT s.institution_id, s.program, n.key,
  CASE WHEN locked THEN n.value ELSE coalesce(p.value, i.value, n.value) END AS value,
  locked AND (p.value IS NOT NULL OR i.value IS NOT NULL) AS refused
FROM s JOIN x_config_national n ON TRUE
LEFT JOIN x_config_institution i ON i.institution_id = s.institution_id AND i.key = n.key
LEFT JOIN x_config_program p ON p.program = s.program AND p.key = n.key""")
def _(t):
    keys = [row[0] for row in R.TABLES["config_national"][1]]
    scopes = t.unit.select("institution_id", "program").distinct().withColumn(
        "key", F.explode(F.array(*[F.lit(k) for k in keys])))
    return J.config_overlay(scopes, t.rule("config_national"), t.rule("config_institution"),
                            t.rule("config_program"))


@query("merge_calendars", """
WITH l AS (SELECT CASE WHEN priority = '1-URGENT' THEN 'CONFERENCE' ELSE 'REVIEW ' || priority END
    AS event, max(start_date) AS deadline, institution AS scope FROM x_au GROUP BY ALL)
SELECT event, CAST(deadline AS VARCHAR) AS deadline, instrument, 'NATIONAL' AS scope
FROM x_calendar_national
UNION ALL SELECT event, CAST(deadline AS VARCHAR), NULL, scope FROM l
WHERE event NOT IN (SELECT event FROM x_calendar_national)""")
def _(t):
    local = t.activity_unit.groupBy(
        F.when(F.col("priority") == "1-URGENT", "CONFERENCE").otherwise(
            F.concat(F.lit("REVIEW "), "priority")).alias("event"),
        F.col("institution").alias("scope")).agg(F.max("start_date").alias("deadline"))
    return J.merge_calendars(t.rule("calendar_national"), local).select(
        "event", day("deadline").alias("deadline"), "instrument", "scope")


query("expand_templates", """
SELECT activity_id, a.execution_mode, step, task_label,
  CAST(CAST(start_date + coalesce(offset_days, 0) AS DATE) AS VARCHAR) AS task_date, TRUE AS editable
FROM x_act a LEFT JOIN x_template t ON a.execution_mode = t.execution_mode""")(
    lambda t: J.expand_templates(t.activity, t.rule("template")).withColumn(
        "task_date", day("task_date")))


@query("object_360", """
WITH l AS (SELECT activity_id, string_agg(seq || ':' || resource_id || ':' || supplier_id || ':' ||
    CAST(total AS VARCHAR) || ':' || line_status, ';' ORDER BY seq, resource_id, supplier_id, total,
    line_status) AS tasks, count(*) AS n_lines, sum(total) AS cost FROM x_line GROUP BY 1),
c AS (SELECT activity_id, count(*) AS n_contracts, max(award_amount) AS largest FROM x_contract
  GROUP BY 1),
p AS (SELECT activity_id, sum(amount) AS paid FROM x_pay WHERE NOT rejected GROUP BY 1)
SELECT activity_id, CASE WHEN tasks IS NOT NULL THEN CAST(0 AS BIGINT) END AS page, tasks, n_lines,
  CAST(cost AS DOUBLE) AS cost, n_contracts, CAST(largest AS DOUBLE) AS largest,
  CAST(paid AS DOUBLE) AS paid FROM x_act LEFT JOIN l USING (activity_id)
LEFT JOIN c USING (activity_id) LEFT JOIN p USING (activity_id)""")
def _(t):
    full = J.object_360(t.activity, t.line, t.payment)
    return full.select(
        "activity_id", "page", F.array_join(F.transform("tasks", lambda x: F.concat_ws(
            ":", x["seq"], x["resource_id"], x["supplier_id"], x["total"], x["line_status"])), ";")
        .alias("tasks"), "costing.n_lines", money("costing.cost").alias("cost"),
        "procurement.n_contracts", money("procurement.largest").alias("largest"),
        money("execution.paid").alias("paid"))


query("orphan_references", """
SELECT supplier_id, count(*) AS n_references FROM x_line WHERE supplier_id NOT IN
  (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0) GROUP BY 1""")(
    lambda t: J.orphan_references(t.line, t.raw("supplier").filter("s_acctbal >= 0").select(
        F.col("s_suppkey").alias("supplier_id")), "supplier_id"))
