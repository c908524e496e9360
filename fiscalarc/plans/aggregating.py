"""Queries of the governed aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import day, money, ratio
from ..operators import aggregates as A
from ..sources import rules as R
from .inputs import (ai_runs, chain, expert_cases, indicator_days, indicator_results, milestones,
                     offers, price_points, projects, recommendations, risks, schedule, staged_facts)
from .registry import VIEWS, query

TODAY = R.TODAY


def _doubles(df, *cols):
    for c in cols:
        df = df.withColumn(c, money(c))
    return df


query("cost_rollup", """
SELECT program, priority, activity_id, CAST(sum(cost) AS DOUBLE) AS cost, count(*) AS n_lines,
  GROUPING(program, priority, activity_id) AS level
FROM (SELECT *, CAST(((CAST(total * 100 AS HUGEINT) * CAST((1 - discount) * 100 AS HUGEINT)
        * CAST((1 + tax) * 100 AS HUGEINT) + 5000) // 10000) AS DECIMAL(18,0))
        * CAST(0.01 AS DECIMAL(3,2)) AS cost FROM x_lu)
GROUP BY ROLLUP (program, priority, activity_id)""")(
    lambda t: A.cost_rollup(t.line_unit, ["program", "priority", "activity_id"]))

query("classification_cube", """
SELECT ministry, program, resource_type, brand, institution, priority,
  CAST(sum(total) AS DOUBLE) AS amount, count(*) AS n_lines,
  GROUPING(ministry, program, resource_type, brand, institution, priority) AS grouping
FROM x_lu JOIN x_price USING (resource_id)
GROUP BY GROUPING SETS ((ministry), (program), (resource_type), (brand), (institution), (priority),
  (program, resource_type), (institution, priority), ())""")(
    lambda t: A.classification_cube(
        t.line_unit.join(t.price.select("resource_id", "resource_type", "brand"), "resource_id"),
        [("ministry",), ("program",), ("resource_type",), ("brand",), ("institution",),
         ("priority",), ("program", "resource_type"), ("institution", "priority"), ()]))

_ENV = ["initial_ceiling", "current_ceiling", "allocated", "reserved", "need", "available"]

query("envelope_balance", f"""
SELECT program, fiscal_year, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _ENV)} FROM x_env""")(
    lambda t: _doubles(t.envelope, *_ENV))

query("over_ceiling", """
SELECT program, fiscal_year, CAST(need AS DOUBLE) AS need, CAST(available AS DOUBLE) AS available,
  CAST(need - available AS DOUBLE) AS shortfall, TRUE AS blocked FROM x_env
WHERE need > available""")(
    lambda t: _doubles(A.over_ceiling(t.envelope), "need", "available", "shortfall").select(
        "program", "fiscal_year", "need", "available", "shortfall", "blocked"))

_SRC = {s: s.lower().replace(" ", "_") for s in R.FUNDING_SOURCES}


@query("funding_plan", f"""
WITH need AS (SELECT program, fiscal_year, sum(total) AS need FROM x_lu GROUP BY ALL),
got AS (SELECT program, fiscal_year, {', '.join(
    f"coalesce(sum(allocation) FILTER (funding_source = '{s}'), 0) AS {c}" for s, c in _SRC.items())}
  FROM x_au JOIN x_funding_map USING (priority) WHERE status IN ('CLOSED', 'IN_EXECUTION')
  GROUP BY ALL)
SELECT program || ':' || fiscal_year AS envelope, CAST(need AS DOUBLE) AS need,
  {', '.join(f'CAST(coalesce({c}, 0) AS DOUBLE) AS {c}' for c in _SRC.values())},
  CAST(greatest(need - {' - '.join(f'coalesce({c}, 0)' for c in _SRC.values())}, 0) AS DOUBLE) AS gap
FROM need LEFT JOIN got USING (program, fiscal_year)""")
def _(t):
    act = t.activity_unit.withColumn("envelope", F.concat_ws(":", "program", "fiscal_year"))
    needs = t.line.join(act.select("activity_id", "envelope"), "activity_id").withColumnRenamed(
        "total", "need")
    funds = (act.filter(F.col("status").isin("CLOSED", "IN_EXECUTION"))
             .join(t.rule("funding_map"), "priority").withColumnRenamed("allocation", "amount"))
    out = A.funding_plan(needs, funds, "envelope", R.FUNDING_SOURCES)
    for s, c in _SRC.items():
        out = out.withColumnRenamed(s, c)
    return _doubles(out, "need", "gap", *_SRC.values())


query("reserve_budget", """
SELECT program, fiscal_year, CAST(round(sum(total) FILTER (status = 'IN_EXECUTION')
   * CAST(0.1 AS DECIMAL(2,1)), 2) AS DOUBLE) AS reserved,
  CAST(sum(total) FILTER (status = 'CLOSED') AS DOUBLE) AS committed FROM x_lu GROUP BY ALL""")(
    lambda t: _doubles(A.reserve_budget(t.line_unit, ["program", "fiscal_year"]), "reserved",
                       "committed"))

_YEARS = list(range(1995, 2002))


@query("ae_cp_profile", f"""
SELECT budget_activity_id, CAST(sum(total) AS DOUBLE) AS ae,
  {', '.join(f'CAST(coalesce(sum(total) FILTER (year(work_date) = {y}), 0) AS DOUBLE) AS cp_{y}'
             for y in _YEARS)},
  CAST(coalesce(sum(total) FILTER (year(work_date) NOT BETWEEN 1995 AND 2001), 0) AS DOUBLE)
    AS cp_other, TRUE AS balanced
FROM x_la GROUP BY budget_activity_id""")
def _(t):
    lines = t.line_activity
    projects = lines.select("budget_activity_id", F.col("total").alias("ae"))
    cp = lines.select("budget_activity_id", F.year("work_date").alias("year"),
                      F.col("total").alias("cp"))
    out = A.ae_cp_profile(projects, cp, "budget_activity_id", _YEARS)
    return _doubles(out, "ae", "cp_other", *[f"cp_{y}" for y in _YEARS])


VIEWS["x_sched"] = """
  SELECT program, activity_id, 'TASK' AS origin, work_date AS period, total AS planned_amount
    FROM x_lu WHERE execution_mode = 'DIRECT' AND line_status = 'O'
  UNION ALL SELECT program, activity_id, 'PROCUREMENT', work_date, total
    FROM x_lu WHERE execution_mode <> 'DIRECT' AND line_status = 'O'
  UNION ALL SELECT program, activity_id, 'PAYMENT', pay_date, amount
    FROM x_pay JOIN x_au USING (activity_id)"""

query("pcc_monthly", """
SELECT program, origin, strftime(period, '%Y-%m') AS month, CAST(sum(planned_amount) AS DOUBLE)
  AS amount FROM x_sched GROUP BY ALL""")(
    lambda t: _doubles(A.pcc_monthly(schedule(t), ["program", "origin"]), "amount"))

query("pcc_quarterly", """
SELECT program, CAST(year(period) AS INT) AS year, CAST(quarter(period) AS INT) AS quarter,
  CAST(sum(planned_amount) AS DOUBLE) AS amount FROM x_sched GROUP BY ALL""")(
    lambda t: _doubles(A.pcc_quarterly(schedule(t), ["program"]), "amount"))


@query("pcc_variance", """
WITH f AS (SELECT program, strftime(work_date, '%Y-%m') AS month, sum(total) AS forecast FROM x_lu
  GROUP BY ALL),
a AS (SELECT program, strftime(pay_date, '%Y-%m') AS month, sum(amount) AS actual
  FROM x_pay JOIN x_au USING (activity_id) WHERE NOT rejected GROUP BY ALL)
SELECT program, month, CAST(coalesce(forecast, 0) AS DOUBLE) AS forecast,
  CAST(coalesce(actual, 0) AS DOUBLE) AS actual,
  CAST(coalesce(actual, 0) - coalesce(forecast, 0) AS DOUBLE) AS variance
FROM f FULL JOIN a USING (program, month)""")
def _(t):
    owner = t.activity_unit.select("activity_id", "program")
    plan = t.line.join(owner, "activity_id").select(
        "program", F.col("work_date").alias("period"), F.col("total").alias("planned_amount"))
    paid = t.payment.filter(~F.col("rejected")).join(owner, "activity_id").select(
        "program", F.col("pay_date").alias("period"), F.col("amount").alias("planned_amount"))
    return _doubles(A.pcc_variance(A.pcc_monthly(plan, ["program"]),
                                   A.pcc_monthly(paid, ["program"]), ["program"]),
                    "forecast", "actual", "variance")


query("cash_stages", """
WITH s AS (
  SELECT program, strftime(start_date, '%Y-%m') AS month, 'allocation' AS stage, allocation AS amount
    FROM x_au
  UNION ALL SELECT program, strftime(signature_date, '%Y-%m'), 'commitment', award_amount
    FROM x_contract JOIN x_au USING (activity_id)
  UNION ALL SELECT program, strftime(pay_date, '%Y-%m'), 'liquidation', amount
    FROM x_pay JOIN x_au USING (activity_id)
  UNION ALL SELECT program, strftime(pay_date, '%Y-%m'), 'payment', amount
    FROM x_pay JOIN x_au USING (activity_id) WHERE NOT rejected)
SELECT *, liquidation - payment AS cash_need FROM (
 SELECT program, month,
  CAST(coalesce(sum(amount) FILTER (stage = 'allocation'), 0) AS DOUBLE) AS allocation,
  CAST(coalesce(sum(amount) FILTER (stage = 'commitment'), 0) AS DOUBLE) AS commitment,
  CAST(coalesce(sum(amount) FILTER (stage = 'liquidation'), 0) AS DOUBLE) AS liquidation,
  CAST(coalesce(sum(amount) FILTER (stage = 'payment'), 0) AS DOUBLE) AS payment
 FROM s GROUP BY ALL)""")(
    lambda t: _doubles(A.cash_stages(staged_facts(t), ["program", "month"]), "allocation",
                       "commitment", "liquidation", "payment", "cash_need"))

VIEWS["x_points"] = """
  SELECT resource_id, 'ESTIMATE' AS source, unit_cents AS cents, work_date AS observed
    FROM x_line WHERE line_status = 'O'
  UNION ALL SELECT resource_id, 'CONTRACT', unit_cents, work_date FROM x_line
    WHERE line_status = 'F' AND return_flag = 'R'
  UNION ALL SELECT resource_id, 'MARKET', unit_cents, work_date FROM x_line
    WHERE line_status = 'F' AND return_flag <> 'R'"""

query("price_history", """
SELECT resource_id, source, count(*) AS n, min(cents) AS low, max(cents) AS high,
  CAST(sum(cents) AS DOUBLE) / count(*) AS mean, quantile_cont(cents, 0.25) AS q25,
  quantile_cont(cents, 0.5) AS median, quantile_cont(cents, 0.75) AS q75
FROM x_points GROUP BY ALL""")(
    lambda t: A.price_history(price_points(t), ["resource_id", "source"], "cents"))


@query("price_confidence", f"""
SELECT resource_id, count(*) AS n, round(0.3 * greatest(0.0, least(1.0,
    1 - date_diff('day', max(observed), DATE '{TODAY}') / 3650.0)) + 0.3 * max(weight)
  + 0.2 * (CAST(count(*) FILTER (cents BETWEEN ref_cents AND 3 * ref_cents) AS DOUBLE) / count(*))
  + 0.2 * least(count(*) / 10.0, 1.0), 6) AS confidence
FROM x_points JOIN x_price USING (resource_id) JOIN x_source_precedence USING (source)
GROUP BY resource_id""")
def _(t):
    seen = (price_points(t).join(t.price.select("resource_id", "ref_cents"), "resource_id")
            .join(t.rule("source_precedence"), "source")
            .select("resource_id", "observed", F.col("weight").alias("source_weight"),
                    F.col("cents").between(F.col("ref_cents"), 3 * F.col("ref_cents"))
                    .cast("long").alias("close")))
    return A.price_confidence(seen, TODAY)


@query("need_aggregation", """
SELECT category, label, institution, funding_source, strftime(work_date, '%Y-%m') AS month,
  count(*) AS n_needs, CAST(sum(total) AS DOUBLE) AS estimated_amount,
  CAST(sum(quantity) AS BIGINT) AS quantity, CAST(min(work_date) AS VARCHAR) AS first_date,
  CAST(max(work_date) AS VARCHAR) AS last_date FROM x_need GROUP BY ALL""")
def _(t):
    needs = t.need.withColumn("month", F.date_format("work_date", "yyyy-MM"))
    out = A.need_aggregation(needs, ["category", "label", "institution", "funding_source", "month"])
    return (_doubles(out, "estimated_amount").withColumn("first_date", day("first_date"))
            .withColumn("last_date", day("last_date")))


@query("mutualisation", """
SELECT resource_id, strftime(work_date, '%Y-%m') AS month,
  count(DISTINCT institution_id) AS n_institutions, count(*) AS n_needs,
  CAST(sum(total) AS DOUBLE) AS amount FROM x_need GROUP BY ALL
HAVING count(DISTINCT institution_id) >= 2""")
def _(t):
    needs = t.need.withColumn("month", F.date_format("work_date", "yyyy-MM"))
    return _doubles(A.mutualisation(needs, ["resource_id", "month"]), "amount")


query("supplier_market", """
SELECT resource_id, count(DISTINCT supplier_id) AS n_bidders, count(*) AS n_offers,
  CAST(sum(date_diff('day', start_date, work_date)) AS DOUBLE) / count(*) AS mean_delay,
  count(*) FILTER (return_flag = 'R') AS n_failed,
  quantile_cont(unit_cents, 0.5) AS median_cents FROM x_la GROUP BY resource_id""")(
    lambda t: A.supplier_market(offers(t), "resource_id"))


@query("readiness_score", """
WITH items AS (SELECT activity_id, unnest(['financing', 'specifications', 'studies', 'site',
    'documents', 'validation']) AS dimension,
  unnest([a.status <> 'IN_PREPARATION', a.allocation > 100000, a.activity_id % 2 = 0,
    a.budget_activity_id % 2 = 0, a.priority <> '5-LOW', a.status = 'CLOSED']) AS ready FROM x_act a)
SELECT activity_id, CAST(sum(weight) FILTER (ready) AS DOUBLE) / sum(weight) AS readiness,
  count(*) FILTER (NOT ready) AS missing FROM items JOIN x_readiness_weight USING (dimension)
GROUP BY activity_id HAVING count(*) FILTER (ready) > 0
UNION ALL SELECT activity_id, 0.0, count(*) FROM items GROUP BY 1 HAVING count(*) FILTER (ready) = 0
""")
def _(t):
    flags = {"financing": F.col("status") != "IN_PREPARATION",
             "specifications": F.col("allocation") > 100000,
             "studies": F.col("activity_id") % 2 == 0, "site": F.col("budget_activity_id") % 2 == 0,
             "documents": F.col("priority") != "5-LOW", "validation": F.col("status") == "CLOSED"}
    items = t.activity.select("activity_id", F.explode(F.array(*[
        F.struct(F.lit(k).alias("dimension"), v.alias("ready")) for k, v in flags.items()]))
        .alias("x")).select("activity_id", "x.*")
    return A.readiness_score(items, t.rule("readiness_weight"), "activity_id")


VIEWS["x_project"] = """
  SELECT u.unit_id AS project_id, u.institution_id, u.institution, u.program, u.score,
    u.unit_id % 10 = 0 AS mandatory, coalesce(n, 0) AS n_orders, coalesce(cost, 0) AS total_cost,
    CAST(least(coalesce(n, 0), 8) AS INT) AS stage
  FROM x_unit u LEFT JOIN (SELECT budget_activity_id, count(*) AS n,
    CAST(sum(allocation) AS DECIMAL(18,2)) AS cost FROM x_act GROUP BY 1) o
  ON u.unit_id = o.budget_activity_id"""

_DIM = {d: i for i, d in enumerate(R.MATURITY_DIMENSIONS)}


@query("maturity_index", f"""
WITH s AS (SELECT project_id, stage, {' + '.join(
    f'(((project_id // {3 ** i}) % 3) / 2.0)' for i in range(7))} AS total FROM x_project)
SELECT project_id, stage, total / 7.0 AS maturity,
  'G' || CAST(least(floor(total * 9 / 7.0), 8) AS INT) AS gate FROM s""")
def _(t):
    scored = projects(t).select("project_id", "stage", *[
        ((F.floor(F.col("project_id") / 3 ** i) % 3) / F.lit(2.0)).alias(d)
        for d, i in _DIM.items()])
    return A.maturity_index(scored, R.MATURITY_DIMENSIONS).select(
        "project_id", "stage", "maturity", "gate")


_BANK = ["Ideas", "Prepared", "Eligible", "Funded", "In PIP", "In execution", "Completed"]

query("project_bank", f"""
SELECT [{', '.join(f"'{b}'" for b in _BANK)}][least(stage, 6) + 1] AS status,
  count(*) AS n_projects, CAST(sum(total_cost) AS DOUBLE) AS amount FROM x_project GROUP BY 1""")(
    lambda t: _doubles(A.project_bank(projects(t).withColumn("status", F.element_at(
        F.array(*[F.lit(b) for b in _BANK]), F.least(F.col("stage"), F.lit(6)) + 1))), "amount"))

VIEWS["x_mile"] = """
  SELECT activity_id, seq, CAST(start_date + CAST(30 * seq AS INT) AS DATE) AS planned_date,
    work_date AS actual_date, quantity AS weight, line_status = 'F' AS done,
    return_flag = 'N' AS evidenced, return_flag, program, execution_mode, total
  FROM x_lu"""

query("physical_progress", """
SELECT activity_id, CAST(coalesce(sum(weight) FILTER (done), 0) AS BIGINT) AS done_weight,
  CAST(sum(weight) AS BIGINT) AS total_weight, count(*) AS n_milestones,
  CAST(coalesce(sum(weight) FILTER (done), 0) AS DOUBLE) / sum(weight) AS progress
FROM x_mile GROUP BY 1""")(lambda t: A.physical_progress(milestones(t), ["activity_id"]))


@query("financial_progress", """
WITH p AS (SELECT program, fiscal_year, sum(amount) AS paid FROM x_pay JOIN x_au USING (activity_id)
  WHERE NOT rejected GROUP BY ALL)
SELECT program, fiscal_year, CAST(a.allocated AS DOUBLE) AS allocated,
  CAST(coalesce(paid, 0) AS DOUBLE) AS paid,
  CAST(coalesce(paid, 0) AS DOUBLE) / CAST(a.allocated AS DOUBLE) AS progress
FROM (SELECT program, fiscal_year, sum(allocation) AS allocated FROM x_au GROUP BY ALL) a
LEFT JOIN p USING (program, fiscal_year)""")
def _(t):
    au = t.activity_unit.select("activity_id", "program", "fiscal_year", "allocation")
    return _doubles(A.financial_progress(t.payment.join(au, "activity_id"), au,
                                         ["program", "fiscal_year"]), "allocated", "paid")


@query("variance_report", """
WITH m AS (SELECT activity_id, sum(date_diff('day', planned_date, actual_date)) AS days,
    count(*) AS n, sum(weight) AS w, coalesce(sum(weight) FILTER (done), 0) AS dw,
    sum(total) AS cost, count(*) FILTER (evidenced) AS ev, count(*) FILTER (done) AS nd
  FROM x_mile GROUP BY 1),
v AS (SELECT a.activity_id, unnest(['SCHEDULE', 'COST', 'PHYSICAL', 'PERFORMANCE', 'PROCUREMENT'])
   AS variance_type,
  unnest([0.0, CAST(a.allocation AS DOUBLE), CAST(w AS DOUBLE), CAST(n AS DOUBLE), CAST(n AS DOUBLE)])
   AS planned,
  unnest([CAST(days AS DOUBLE) / n, CAST(cost AS DOUBLE), CAST(dw AS DOUBLE), CAST(nd AS DOUBLE),
   CAST(ev AS DOUBLE)]) AS actual FROM m JOIN x_act a USING (activity_id))
SELECT *, CASE variance_type WHEN 'SCHEDULE' THEN actual - planned
  ELSE (actual - planned) / nullif(planned, 0) END AS variance FROM v""")
def _(t):
    m = milestones(t).groupBy("activity_id").agg(
        ratio(F.sum(F.date_diff("actual_date", "planned_date")), A.n_rows())
        .alias("schedule_actual"),
        F.sum("total").alias("cost_actual"), F.sum("weight").alias("physical_planned"),
        F.sum(F.when(F.col("done"), F.col("weight")).otherwise(0)).alias("physical_actual"),
        A.n_rows().alias("performance_planned"),
        F.sum(F.col("done").cast("long")).alias("performance_actual"),
        A.n_rows().alias("procurement_planned"),
        F.sum(F.col("evidenced").cast("long")).alias("procurement_actual"))
    pairs = m.join(t.activity.select("activity_id", F.col("allocation").alias("cost_planned")),
                   "activity_id").withColumn("schedule_planned", F.lit(0.0))
    return A.variance_report(pairs, "activity_id")


@query("root_cause_counts", """
SELECT cause, count(*) AS n, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS share
FROM x_la JOIN x_cause_map ON cause_no = supplier_id % 6
WHERE work_date > start_date + CAST(30 * seq AS INT) AND return_flag <> 'N' GROUP BY cause""")
def _(t):
    late = t.line_activity.filter(F.col("work_date") > F.date_add("start_date", F.col("seq") * 30))
    named = late.withColumn("cause_no", (F.col("supplier_id") % 6).cast("int")).join(
        t.rule("cause_map"), "cause_no").withColumn("confirmed", F.col("return_flag") != "N")
    return A.root_cause_counts(named)


@query("disaggregate", """
WITH o AS (SELECT kind, value, unnest(['sex', 'age', 'territory', 'beneficiary', 'disability'])
  AS dimension, unnest([CASE WHEN k % 2 = 0 THEN 'F' ELSE 'M' END,
    CASE WHEN k < 30 THEN 'young' WHEN k < 60 THEN 'adult' ELSE 'senior' END,
    'T' || actor % 25, CASE WHEN actor % 3 = 0 THEN 'household' ELSE 'person' END,
    CASE WHEN k % 10 = 0 THEN 'yes' ELSE 'no' END]) AS member FROM x_ev)
SELECT kind, dimension, member, count(*) AS n, CAST(sum(value) AS DOUBLE) AS amount
FROM o GROUP BY ALL""")
def _(t):
    k, actor = F.col("k"), F.col("actor")
    obs = t.event.withColumn("disaggregation", F.create_map(
        F.lit("sex"), F.when(k % 2 == 0, "F").otherwise("M"),
        F.lit("age"), F.when(k < 30, "young").when(k < 60, "adult").otherwise("senior"),
        F.lit("territory"), F.concat(F.lit("T"), (actor % 25).cast("string")),
        F.lit("beneficiary"), F.when(actor % 3 == 0, "household").otherwise("person"),
        F.lit("disability"), F.when(k % 10 == 0, "yes").otherwise("no")))
    return _doubles(A.disaggregate(obs, "kind", "value"), "amount")


@query("territorial_rollup", """
SELECT r_name AS department, n_name AS commune, CAST(sum(value) AS DOUBLE) AS amount,
  count(*) AS n, GROUPING(r_name, n_name) AS level
FROM x_ev JOIN nation ON n_nationkey = actor % 25 JOIN region ON n_regionkey = r_regionkey
GROUP BY ROLLUP (r_name, n_name)""")
def _(t):
    place = t.ministry.select(F.col("ministry_id").alias("place"),
                              F.col("institution").alias("department"),
                              F.col("ministry").alias("commune"))
    obs = t.event.withColumn("place", (F.col("actor") % 25).cast("int")).join(place, "place")
    return _doubles(A.territorial_rollup(obs, ["department", "commune"], "value"), "amount")


query("cross_cutting_tags", """
SELECT tag, CAST(sum(total) AS DOUBLE) AS amount, count(*) AS n_lines
FROM x_line JOIN x_tag_map ON digit = resource_id % 10 GROUP BY tag""")(
    lambda t: _doubles(A.cross_cutting_tags(
        t.line.withColumn("digit", (F.col("resource_id") % 10).cast("int")), t.rule("tag_map"),
        "digit"), "amount"))


@query("unit_cost", """
SELECT ministry, CAST(c.cost AS DOUBLE) AS cost, output,
  CAST(c.cost AS DOUBLE) / output AS unit_cost
FROM (SELECT ministry, sum(total) AS cost FROM x_lu GROUP BY 1) c
LEFT JOIN (SELECT ministry, CAST(sum(quantity) AS BIGINT) AS output FROM x_lu
  WHERE line_status = 'F' GROUP BY 1) o USING (ministry)""")
def _(t):
    lu = t.line_unit
    out = A.unit_cost(lu.withColumnRenamed("total", "cost"),
                      lu.filter("line_status = 'F'").withColumnRenamed("quantity", "output"),
                      "ministry")
    return _doubles(out, "cost")


VIEWS["x_ires"] = """
  SELECT e.* EXCLUDE (slot), i.direction, i.program, t.target,
    CASE direction WHEN 'LOWER' THEN actual <= target ELSE actual >= target END AS reached
  FROM (SELECT kind AS indicator, CAST((day(day) - 1) // 7 + 1 AS INT) AS slot,
      CAST((year(day) - 2020) * 60 + (month(day) - 1) * 5 + (day(day) - 1) // 7 + 1 AS INT) AS week,
      CAST(sum(value) AS DOUBLE) / count(*) AS actual, count(*) AS n FROM x_ev GROUP BY ALL) e
  JOIN x_indicator i USING (indicator) JOIN x_indicator_target t
    ON t.indicator = e.indicator AND t.week = e.slot"""

query("effectiveness", """
SELECT indicator, count(*) AS n_targets, count(*) FILTER (reached) AS n_reached,
  CAST(count(*) FILTER (reached) AS DOUBLE) / count(*) AS share FROM x_ires GROUP BY 1""")(
    lambda t: A.effectiveness(indicator_results(t), ["indicator"]))


@query("output_outcome_balance", """
SELECT program, count(*) AS n_indicators FROM x_indicator
WHERE indicator IN (SELECT kind FROM x_ev) GROUP BY program HAVING bool_and(type = 'ACTIVITY')""")
def _(t):
    used = t.event.select(F.col("kind").alias("indicator")).distinct()
    return A.output_outcome_balance(used.join(t.rule("indicator"), "indicator"))


@query("indicator_quality", """
SELECT indicator, definition IS NOT NULL AS has_definition, formula IS NOT NULL AS has_formula,
  source IS NOT NULL AS has_source, frequency IS NOT NULL AS has_frequency,
  baseline IS NOT NULL AS has_baseline, indicator IN (SELECT indicator FROM x_indicator_target)
    AS has_target,
  (definition IS NOT NULL)::INT + (formula IS NOT NULL)::INT + (source IS NOT NULL)::INT
  + (frequency IS NOT NULL)::INT + (baseline IS NOT NULL)::INT
  + (indicator IN (SELECT indicator FROM x_indicator_target))::INT AS n_present
FROM x_indicator WHERE indicator IN (SELECT kind FROM x_ev)""")
def _(t):
    used = t.event.select(F.col("kind").alias("indicator")).distinct()
    return A.indicator_quality(used.join(t.rule("indicator"), "indicator"),
                               t.rule("indicator_target"))


@query("rap_dataset", """
WITH b AS (SELECT program, sum(allocation) AS budget FROM x_au GROUP BY 1),
p AS (SELECT program, sum(amount) AS execution FROM x_pay JOIN x_au USING (activity_id)
  WHERE NOT rejected GROUP BY 1)
SELECT program, 'Objective ' || program AS objective, indicator, week, target, actual,
  CAST(budget AS DOUBLE) AS budget, CAST(execution AS DOUBLE) AS execution,
  (actual - target) / target AS variance
FROM x_ires JOIN b USING (program) LEFT JOIN p USING (program)""")
def _(t):
    au = t.activity_unit.select("activity_id", "program", "allocation")
    money_by_program = A.financial_progress(t.payment.join(au, "activity_id"), au, ["program"])
    out = indicator_results(t).join(money_by_program, "program").select(
        "program", F.concat(F.lit("Objective "), "program").alias("objective"), "indicator", "week",
        "target", "actual", money("allocated").alias("budget"), money("paid").alias("execution"),
        ((F.col("actual") - F.col("target")) / F.col("target")).alias("variance"))
    return out


@query("pap_view", """
SELECT program, fiscal_year, indicator, label, baseline, target,
  CAST(allocation AS DOUBLE) AS allocation, n_actions
FROM (SELECT program, fiscal_year, sum(allocation) AS allocation, count(DISTINCT priority) AS n_actions
  FROM x_au GROUP BY ALL) LEFT JOIN x_indicator USING (program)
LEFT JOIN (SELECT indicator, max(target) AS target FROM x_indicator_target GROUP BY 1)
  USING (indicator)""")
def _(t):
    annual = t.activity_unit.groupBy("program", "fiscal_year", "priority").agg(
        F.sum("allocation").alias("_a")).groupBy("program", "fiscal_year").agg(
        money(F.sum("_a")).alias("allocation"), A.n_rows().alias("n_actions"))
    targets = t.rule("indicator_target").groupBy("indicator").agg(F.max("target").alias("target"))
    return annual.join(t.rule("indicator"), "program", "left").join(
        F.broadcast(targets), "indicator", "left").select(
        "program", "fiscal_year", "indicator", "label", "baseline", "target", "allocation",
        "n_actions")


query("multi_year_projection", """
SELECT program, CAST(y AS INT) AS year,
  round(amount * pow(1 + rate_pct / 100.0, y - 2002 + 1), 2) AS projected
FROM (SELECT program, CAST(sum(allocation) AS DOUBLE) / count(DISTINCT fiscal_year) AS amount FROM x_au
  GROUP BY 1)
JOIN x_growth USING (program), range(2002, 2005) r(y)""")(
    lambda t: A.multi_year_projection(
        t.activity_unit.groupBy("program").agg((
            F.sum("allocation").cast("double") / F.countDistinct("fiscal_year")).alias("amount")),
        t.rule("growth"), 2002, 3))


@query("conference_pack", f"""
WITH h AS (SELECT program, CAST(sum(allocation) FILTER (fiscal_year < 2001) AS DOUBLE) AS history,
    CAST(sum(allocation) FILTER (fiscal_year = 2001) AS DOUBLE) AS budget,
    count(*) FILTER (fiscal_year = 2001) AS n_activities,
    count(*) FILTER (status = 'IN_PREPARATION') AS n_open_decisions FROM x_au GROUP BY 1),
i AS (SELECT program, count(DISTINCT indicator) AS n_indicators, max(target) AS best_target
  FROM x_ires GROUP BY 1),
r AS (SELECT program, count(*) FILTER (need > available) AS n_risks FROM x_env GROUP BY 1)
SELECT program, history, budget, n_activities, n_open_decisions,
  coalesce(n_indicators, 0) AS n_indicators, best_target, n_risks
FROM h LEFT JOIN i USING (program) LEFT JOIN r USING (program)""")
def _(t):
    year = F.col("fiscal_year")
    h = t.activity_unit.groupBy("program").agg(
        money(F.sum(F.when(year < 2001, F.col("allocation")))).alias("history"),
        money(F.sum(F.when(year == 2001, F.col("allocation")))).alias("budget"),
        F.sum((year == 2001).cast("long")).alias("n_activities"),
        F.sum((F.col("status") == "IN_PREPARATION").cast("long")).alias("n_open_decisions"))
    i = indicator_results(t).groupBy("program").agg(
        F.countDistinct("indicator").alias("n_indicators"), F.max("target").alias("best_target"))
    r = t.envelope.groupBy("program").agg(
        F.sum((F.col("need") > F.col("available")).cast("long")).alias("n_risks"))
    return (h.join(i, "program", "left").join(r, "program", "left")
            .withColumn("n_indicators", F.coalesce("n_indicators", F.lit(0))))


VIEWS["x_rec"] = """
  SELECT event_id, 'S' || k % 4 AS source, actor AS owner, day AS opened_on,
    CAST(day + 7 AS DATE) AS deadline,
    (SELECT min(p.ts) FROM x_ev p WHERE p.actor = e.actor AND p.kind = 'purchase' AND p.ts > e.ts)
      AS closed_ts
  FROM x_ev e WHERE kind = 'error'"""

query("recommendation_tracking", """
SELECT source, count(*) AS n, count(closed_ts) AS n_closed,
  count(*) FILTER (closed_ts IS NULL) AS n_open,
  count(*) FILTER (closed_ts IS NULL AND deadline < DATE '2024-01-31') AS n_overdue
FROM x_rec GROUP BY 1""")(
    lambda t: A.recommendation_tracking(recommendations(t), "2024-01-31"))


@query("corrective_actions", """
WITH r AS (SELECT * FROM x_rec)
SELECT owner, count(*) AS n_issues, count(*) FILTER (closed_ts IS NULL) AS n_without_action,
  count(*) FILTER (CAST(closed_ts AS DATE) <= deadline) AS n_done,
  count(*) FILTER (CAST(closed_ts AS DATE) > deadline AND deadline < DATE '2024-01-31') AS n_late
FROM r GROUP BY owner""")
def _(t):
    recs = recommendations(t)
    issues = recs.select(F.col("event_id").alias("issue_id"), "owner")
    in_time = F.col("closed_on") <= F.col("deadline")
    actions = recs.filter(F.col("closed_on").isNotNull()).select(
        F.col("event_id").alias("issue_id"), "deadline",
        F.when(in_time, F.col("closed_on")).alias("done_on"))
    return A.corrective_actions(issues, actions, "2024-01-31")


query("evidence_coverage", """
SELECT execution_mode, count(*) AS n_claims, count(*) FILTER (evidenced) AS n_backed,
  CAST(count(*) FILTER (evidenced) AS DOUBLE) / count(*) AS coverage
FROM (SELECT execution_mode, line_status = 'F' AS done, return_flag = 'A' AS evidenced FROM x_la)
WHERE done GROUP BY 1""")(
    lambda t: A.evidence_coverage(
        t.line_activity.select("execution_mode", (F.col("line_status") == "F").alias("done"),
                               (F.col("return_flag") == "A").alias("evidenced")),
        "execution_mode"))


@query("evaluation_matrix", f"""
WITH q AS (SELECT actor AS evaluation, k % 6 AS c FROM x_ev WHERE kind = 'view')
SELECT evaluation, {', '.join(f'count(*) FILTER (c = {i}) AS "{c}"'
                              for i, c in enumerate(R.CRITERIA))},
  CAST({' + '.join(f'(count(*) FILTER (c = {i}) = 0)::INT' for i in range(6))} AS INT) AS n_uncovered
FROM q GROUP BY 1""")
def _(t):
    names = F.array(*[F.lit(c) for c in R.CRITERIA])
    return A.evaluation_matrix(t.event.filter("kind = 'view'").select(
        F.col("actor").alias("evaluation"),
        F.element_at(names, (F.col("k") % 6).cast("int") + 1).alias("criterion")), R.CRITERIA)


@query("review_comments", """
WITH c AS (SELECT conv_id AS activity, turn % 3 AS field, NOT EXISTS (SELECT 1 FROM conversations n
    WHERE n.conv_id = u.conv_id AND n.turn = u.turn + 1 AND n.role = 'assistant') AS open
  FROM conversations u WHERE role = 'user')
SELECT activity, field, count(*) AS n_open, CAST(GROUPING(field) AS INT) AS whole_activity
FROM c WHERE open GROUP BY GROUPING SETS ((activity), (activity, field))""")
def _(t):
    talk = t.raw("conversations")
    answers = talk.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.lit(True).alias("resolved")).distinct()
    comments = talk.filter("role = 'user'").join(answers, ["conv_id", "turn"], "left").select(
        F.col("conv_id").alias("activity"), (F.col("turn") % 3).alias("field"),
        F.coalesce("resolved", F.lit(False)).alias("resolved"))
    return A.review_comments(comments)


query("risk_matrix", f"""
WITH r AS (SELECT CAST(1 + actor % 5 AS INT) AS probability, 1 + k % 5 AS impact FROM x_ev)
SELECT probability, {', '.join(f'count(*) FILTER (impact = {i}) AS impact_{i}' for i in range(1, 6))},
  CAST(sum(probability * impact) AS BIGINT) AS exposure FROM r GROUP BY 1""")(
    lambda t: A.risk_matrix(risks(t)))


@query("planning_kpis", f"""
WITH l AS (SELECT activity_id, count(*) AS n, sum(total) AS cost, max(work_date) AS last_date
  FROM x_line GROUP BY 1)
SELECT program, count(*) AS n_activities, count(*) FILTER (n IS NOT NULL AND status <> 'IN_PREPARATION')
    AS n_complete, count(*) FILTER (n IS NULL) AS n_missing_tasks,
  count(*) FILTER (cost IS NULL) AS n_missing_costing,
  count(*) FILTER (cost > allocation) AS n_over_ceiling,
  count(*) FILTER (activity_id % 4 = 0) AS n_gap,
  count(*) FILTER (status = 'IN_EXECUTION' AND last_date < DATE '{TODAY}') AS n_late
FROM x_au LEFT JOIN l USING (activity_id) GROUP BY 1""")
def _(t):
    per = t.line.groupBy("activity_id").agg(A.n_rows().alias("n"), F.sum("total").alias("cost"),
                                            F.max("work_date").alias("last_date"))
    a = t.activity_unit.join(per, "activity_id", "left")
    def n(c):
        return F.count_if(c)
    return a.groupBy("program").agg(
        A.n_rows().alias("n_activities"),
        n(F.col("n").isNotNull() & (F.col("status") != "IN_PREPARATION")).alias("n_complete"),
        n(F.col("n").isNull()).alias("n_missing_tasks"),
        n(F.col("cost").isNull()).alias("n_missing_costing"),
        n(F.col("cost") > F.col("allocation")).alias("n_over_ceiling"),
        n(F.col("activity_id") % 4 == 0).alias("n_gap"),
        n((F.col("status") == "IN_EXECUTION") & (F.col("last_date") < F.lit(TODAY).cast("date")))
        .alias("n_late"))


@query("costing_kpis", f"""
WITH p AS (SELECT resource_id, max(work_date) AS seen FROM x_line GROUP BY 1)
SELECT (SELECT count(*) FROM x_act WHERE activity_id NOT IN (SELECT activity_id FROM x_line))
    AS n_uncosted,
  (SELECT count(*) FROM x_line JOIN x_price USING (resource_id)
   WHERE (unit_cents - ref_cents) * 5 > ref_cents) AS n_anomalies,
  (SELECT CAST(sum(date_diff('day', seen, DATE '{TODAY}')) AS DOUBLE) / count(*) FROM p)
    AS mean_reference_age""")
def _(t):
    uncosted = t.activity.join(t.line.select("activity_id").distinct(), "activity_id", "left_anti")
    gaps = t.line.join(t.price, "resource_id").filter(
        (F.col("unit_cents") - F.col("ref_cents")) * 5 > F.col("ref_cents"))
    ages = t.line.groupBy("resource_id").agg(F.max("work_date").alias("seen")).select(
        F.date_diff(F.lit(TODAY).cast("date"), "seen").cast("long").alias("age"))
    facts = (uncosted.select(F.lit("u").alias("what"), F.lit(0).cast("long").alias("age"))
             .unionByName(gaps.select(F.lit("g").alias("what"), F.lit(0).cast("long").alias("age")))
             .unionByName(ages.select(F.lit("a").alias("what"), "age")))
    what = F.col("what")
    return facts.agg(F.count_if(what == "u").alias("n_uncosted"),
                     F.count_if(what == "g").alias("n_anomalies"),
                     ratio(F.sum("age"), F.count_if(what == "a")).alias("mean_reference_age"))


query("budget_kpis", """
SELECT fiscal_year, CAST(sum(need) AS DOUBLE) AS need, CAST(sum(current_ceiling) AS DOUBLE) AS ceiling,
  CAST(sum(allocated) AS DOUBLE) AS allocation, CAST(sum(available) AS DOUBLE) AS available,
  CAST(sum(greatest(need - available, 0)) AS DOUBLE) AS gap FROM x_env GROUP BY 1""")(
    lambda t: t.envelope.groupBy("fiscal_year").agg(
        money(F.sum("need")).alias("need"), money(F.sum("current_ceiling")).alias("ceiling"),
        money(F.sum("allocated")).alias("allocation"), money(F.sum("available")).alias("available"),
        money(F.sum(F.greatest(F.col("need") - F.col("available"),
                               F.lit(0).cast("decimal(20,2)")))).alias("gap")))


@query("quality_scores", """
WITH d AS (SELECT count(*) AS n, count(DISTINCT row(activity_id, seq)) AS u FROM x_line)
SELECT count(*) AS n_rows,
  CAST(count(*) FILTER (l.activity_id IS NOT NULL AND l.resource_id IS NOT NULL) AS DOUBLE) / count(*)
    AS completeness,
  CAST(count(*) FILTER (quantity <= 45) AS DOUBLE) / count(*) AS validity,
  CAST(count(*) FILTER (discount < 0.1) AS DOUBLE) / count(*) AS accuracy,
  CAST(count(*) FILTER (work_date >= start_date) AS DOUBLE) / count(*) AS consistency,
  CAST(count(*) FILTER (work_date >= DATE '1996-01-01') AS DOUBLE) / count(*) AS timeliness,
  CAST(count(*) FILTER (status IS NOT NULL) AS DOUBLE) / count(*) AS integrity,
  (SELECT CAST(u AS DOUBLE) / n FROM d) AS uniqueness
FROM x_line l LEFT JOIN x_act a USING (activity_id)""")
def _(t):
    return A.quality_scores(t.line.join(t.activity, "activity_id", "left"), {
        "completeness": F.col("activity_id").isNotNull() & F.col("resource_id").isNotNull(),
        "validity": F.col("quantity") <= 45, "accuracy": F.col("discount") < 0.1,
        "consistency": F.col("work_date") >= F.col("start_date"),
        "timeliness": F.col("work_date") >= F.lit("1996-01-01").cast("date"),
        "integrity": F.col("status").isNotNull()}, ["activity_id", "seq"])


@query("quality_incidents", """
WITH c AS (SELECT count(*) AS n, count(*) FILTER (quantity > 45) AS a,
    count(*) FILTER (discount = 0.1) AS b, count(*) FILTER (work_date < start_date) AS c FROM x_la),
l AS (SELECT n, unnest(['quantity_over_45', 'discount_at_limit', 'work_before_start']) AS rule,
  unnest([a, b, c]) AS n_failed FROM c)
SELECT 'costing_line' AS dataset, rule, dimension, severity, owner, 'OPEN' AS status, n_failed,
  CAST(n_failed AS DOUBLE) / n AS rate FROM l JOIN x_invalid_rule USING (rule)
WHERE CAST(n_failed AS DOUBLE) / n > max_rate""")
def _(t):
    return A.quality_incidents(t.line_activity, {
        "quantity_over_45": F.col("quantity") > 45,
        "discount_at_limit": F.col("discount") == F.lit("0.10").cast("decimal(4,2)"),
        "work_before_start": F.col("work_date") < F.col("start_date")},
        t.rule("invalid_rule"), "costing_line")


query("profile_table", """
WITH l AS (SELECT unnest(['quantity', 'total', 'discount', 'tax']) AS column_name,
  unnest([CAST(quantity AS DECIMAL(18,2)), total, CAST(discount AS DECIMAL(18,2)),
    CAST(tax AS DECIMAL(18,2))]) AS value FROM x_line)
SELECT column_name, count(*) AS n_rows, count(*) FILTER (value IS NULL) AS n_nulls,
  count(DISTINCT value) AS n_distinct, CAST(min(value) AS DOUBLE) AS low,
  CAST(max(value) AS DOUBLE) AS high, quantile_cont(CAST(value AS DOUBLE), 0.5) AS median
FROM l GROUP BY 1""")(
    lambda t: A.profile_table(t.line, ["quantity", "total", "discount", "tax"]))


@query("profile_sketch", """
WITH l AS (SELECT unnest(['quantity', 'total', 'discount', 'tax']) AS column_name,
  unnest([CAST(quantity AS DECIMAL(18,2)), total, CAST(discount AS DECIMAL(18,2)),
    CAST(tax AS DECIMAL(18,2))]) AS value FROM x_line)
SELECT column_name, count(*) AS n_rows, count(*) FILTER (value IS NULL) AS n_nulls,
  CAST(min(value) AS DOUBLE) AS low, CAST(max(value) AS DOUBLE) AS high,
  count(DISTINCT value) AS n_distinct, TRUE AS distinct_within_3_percent, TRUE AS median_within_2_percent_of_rows
FROM l GROUP BY 1""")
def _(t):
    """Sketches per execution mode, merged, with their error measured beside the exact figures."""
    columns = ["quantity", "total", "discount", "tax"]
    lines = t.line_activity.select("execution_mode", *columns)
    modes = [r[0] for r in t.activity.select("execution_mode").distinct().collect()]  # three
    parts = [A.sketch_profile(lines.filter(F.col("execution_mode") == m), columns) for m in sorted(modes)]
    told = A.read_profile(A.merge_profiles(reduce(DataFrame.unionByName, parts)))
    told = told.withColumnRenamed("n_distinct", "estimate").withColumnRenamed("median", "middle")
    exact = A.profile_table(t.line, columns).select("column_name", "n_distinct")
    below = t.line.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double")
                                                       .alias("value")) for c in columns])).alias("x")).select(
        "x.*").join(F.broadcast(told.select("column_name", "middle")), "column_name").groupBy("column_name").agg(
        F.avg((F.col("value") < F.col("middle")).cast("double")).alias("less"),
        F.avg((F.col("value") <= F.col("middle")).cast("double")).alias("upto"))
    return told.join(exact, "column_name").join(below, "column_name").select(
        "column_name", "n_rows", "n_nulls", "low", "high", "n_distinct",
        (F.abs(F.col("estimate") - F.col("n_distinct")) <= 0.03 * F.col("n_distinct")).alias("distinct_within_3_percent"),
        ((F.col("less") <= 0.52) & (F.col("upto") >= 0.48)).alias("median_within_2_percent_of_rows"))


@query("migration_reconcile", """
WITH s AS (SELECT * FROM x_act), r AS (SELECT * FROM x_act WHERE allocation < 1000),
d AS (SELECT * FROM x_act WHERE allocation >= 1000)
SELECT (SELECT count(*) FROM s) AS n_source, (SELECT CAST(sum(allocation) AS DOUBLE) FROM s) AS sum_source,
  (SELECT count(*) FROM d) AS n_target, (SELECT CAST(sum(allocation) AS DOUBLE) FROM d) AS sum_target,
  (SELECT count(*) FROM r) AS n_rejected, (SELECT CAST(sum(allocation) AS DOUBLE) FROM r)
   AS sum_rejected, CAST(0 AS BIGINT) AS n_unexplained, CAST(0 AS BIGINT) AS n_unexpected,
  TRUE AS reconciled""")
def _(t):
    act = t.activity
    out = A.migration_reconcile(act, act.filter("allocation >= 1000"),
                                act.filter("allocation < 1000"), "activity_id", "allocation")
    return _doubles(out, "sum_source", "sum_target", "sum_rejected")


@query("contradictions", """
WITH c AS (SELECT resource_id, work_date, unit_cents, supplier_id FROM x_line),
v AS (SELECT resource_id || ':' || work_date AS fact, unit_cents, count(DISTINCT supplier_id)
  AS n_sources, min(supplier_id) AS first_source FROM c GROUP BY ALL)
SELECT fact, unit_cents, n_sources, first_source,
  count(*) OVER (PARTITION BY fact) AS n_values FROM v
QUALIFY count(*) OVER (PARTITION BY fact) > 1""")
def _(t):
    facts = t.line.select(F.concat_ws(":", "resource_id", day("work_date")).alias("fact"),
                          "unit_cents", "supplier_id")
    return A.contradictions(facts, "fact", "unit_cents", "supplier_id")


@query("kpi_ratios", """
WITH l AS (SELECT activity_id, count(*) AS n, sum(total) AS cost, sum(total) FILTER
   (line_status = 'F' AND return_flag <> 'R') AS result, count(*) FILTER (discount > 0) AS doc
  FROM x_line GROUP BY 1)
SELECT institution, CAST(count(*) FILTER (status <> 'IN_PREPARATION') AS DOUBLE) / count(*)
    AS active_share,
  CAST(count(*) FILTER (execution_mode <> 'DIRECT' AND n > 0) AS DOUBLE)
    / count(*) FILTER (execution_mode <> 'DIRECT') AS plan_from_activity,
  CAST(count(*) FILTER (doc = n) AS DOUBLE) / count(*) AS documented_costing,
  CAST(coalesce(sum(result), 0) AS DOUBLE) / CAST(sum(cost) AS DOUBLE) AS spend_linked
FROM x_au LEFT JOIN l USING (activity_id) GROUP BY 1""")
def _(t):
    per = t.line.groupBy("activity_id").agg(
        A.n_rows().alias("n"), F.sum("total").alias("cost"),
        F.sum(F.when((F.col("line_status") == "F") & (F.col("return_flag") != "R"),
                     F.col("total"))).alias("result"), F.count_if(F.col("discount") > 0).alias("doc"))
    a = t.activity_unit.join(per, "activity_id", "left")
    external = F.col("execution_mode") != "DIRECT"
    return a.groupBy("institution").agg(
        ratio(F.count_if(F.col("status") != "IN_PREPARATION"), A.n_rows()).alias("active_share"),
        ratio(F.count_if(external & (F.col("n") > 0)), F.count_if(external))
        .alias("plan_from_activity"),
        ratio(F.count_if(F.col("doc") == F.col("n")), A.n_rows()).alias("documented_costing"),
        ratio(F.coalesce(F.sum("result"), F.lit(0)), F.sum("cost")).alias("spend_linked"))


query("traceable_share", """
WITH c AS (SELECT program, l.total AS spending, activity_id % 4 <> 0 AS has_objective,
    line_status = 'F' AND return_flag <> 'R' AS has_payment, return_flag = 'N' OR line_status = 'F'
    AS has_result FROM x_lu l)
SELECT program, CAST(sum(spending) AS DOUBLE) AS amount,
  CAST(coalesce(sum(spending) FILTER (has_objective AND has_payment AND has_result), 0) AS DOUBLE)
   / CAST(sum(spending) AS DOUBLE) AS traceable FROM c GROUP BY 1""")(
    lambda t: A.traceable_share(chain(t), ["program"]))

query("benefits_before_after", """
SELECT CASE WHEN day < DATE '2024-01-16' THEN 'before' ELSE 'after' END AS phase,
  count(*) AS n_facts, count(DISTINCT actor) AS n_users,
  CAST(sum(value) AS DOUBLE) / count(*) AS mean_value,
  CAST(count(*) FILTER (kind = 'error') AS DOUBLE) / count(*) AS error_share FROM x_ev GROUP BY 1""")(
    lambda t: A.benefits_before_after(t.event, "2024-01-16", []))

query("ai_finops", """
SELECT CAST(actor % 25 AS INT) AS organisation, kind AS agent, k % 3 AS model,
  CAST(sum(value) AS DOUBLE) AS cost, count(*) AS n_runs,
  GROUPING(CAST(actor % 25 AS INT), kind, k % 3) AS level
FROM x_ev GROUP BY ROLLUP (CAST(actor % 25 AS INT), kind, k % 3)""")(
    lambda t: _doubles(A.ai_finops(ai_runs(t)), "cost"))

query("ai_feedback", """
SELECT k % 3 AS model, CAST(count(*) FILTER (kind = 'purchase') AS DOUBLE)
    / count(*) FILTER (kind IN ('purchase', 'click', 'error')) AS acceptance_rate,
  CAST(count(*) FILTER (kind = 'click') AS DOUBLE)
    / count(*) FILTER (kind IN ('purchase', 'click', 'error')) AS edit_rate,
  CAST(count(*) FILTER (kind = 'error') AS DOUBLE)
    / count(*) FILTER (kind IN ('purchase', 'click', 'error')) AS reject_rate,
  CAST(sum(value) AS DOUBLE) / count(*) FILTER (kind = 'purchase') AS cost_per_accepted
FROM x_ev GROUP BY 1""")(lambda t: A.ai_feedback(ai_runs(t), ["model"]))

query("eval_metrics", """
WITH j AS (SELECT lang, CAST(n_chars >= 500 AS INT) AS p, quality AS g
  FROM documents JOIN labels USING (doc_id))
SELECT lang, count(*) AS n, count(*) FILTER (p = 1 AND g = 1) AS tp,
  count(*) FILTER (p = 1 AND g = 0) AS fp, count(*) FILTER (p = 0 AND g = 1) AS fn,
  CAST(count(*) FILTER (p = g) AS DOUBLE) / count(*) AS accuracy,
  CAST(count(*) FILTER (p = 1 AND g = 1) AS DOUBLE) / nullif(count(*) FILTER (p = 1), 0) AS precision,
  CAST(count(*) FILTER (p = 1 AND g = 1) AS DOUBLE) / nullif(count(*) FILTER (g = 1), 0) AS recall
FROM j GROUP BY 1""")(lambda t: A.eval_metrics(*expert_cases(t), "doc_id", ["lang"]))


@query("canary_compare", """
WITH j AS (SELECT lang, CAST(CAST(n_chars >= 500 AS INT) = quality AS INT) AS a,
    CAST(CAST(n_chars >= 1000 AS INT) = quality AS INT) AS b,
    CAST(n_chars >= 500 AS INT) AS pa, CAST(n_chars >= 1000 AS INT) AS pb
  FROM documents JOIN labels USING (doc_id))
SELECT lang, count(*) AS n_cases, CAST(sum(b - a) AS DOUBLE) / count(*) AS delta_correct,
  CAST(sum(pb - pa) AS DOUBLE) / count(*) AS delta_positive FROM j GROUP BY 1""")
def _(t):
    def model(limit):
        predicted, gold = expert_cases(t, limit)
        return predicted.join(gold, "doc_id").select(
            "doc_id", "lang", (F.col("predicted") == F.col("expected")).cast("int").alias("correct"),
            F.col("predicted").alias("positive"))
    return A.canary_compare(model(500), model(1000), "doc_id", ["correct", "positive"], ["lang"])


query("slo_report", """
SELECT kind, count(*) AS n_calls, CAST(count(*) FILTER (k % 20 = 0) AS DOUBLE) / count(*) AS error_rate,
  CAST(count(*) FILTER (k % 20 <> 0) AS DOUBLE) / count(*) AS availability,
  quantile_cont(CAST(value AS DOUBLE), 0.95) AS p95 FROM x_ev GROUP BY 1""")(
    lambda t: A.slo_report(t.event, "kind", "value", F.col("k") % 20 == 0))
