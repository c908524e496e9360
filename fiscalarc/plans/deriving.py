"""Queries of derivation and what-if jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import day, money
from ..operators import derive as D
from ..scale import windowed
from ..sources import rules as R
from .aggregating import _doubles
from .graphs import tree
from .inputs import price_points, recommendations, schedule
from .registry import VIEWS, query
from .windowing import FULL_ORDER

query("derive_needs", """
SELECT activity_id || '-' || seq || '-' || resource_id || '-' || supplier_id AS need_id, fiscal_year,
  activity_id AS source_activity, seq AS source_task, label AS description, category, quantity,
  CAST(total AS DOUBLE) AS estimated_amount, CAST(work_date AS VARCHAR) AS needed_by_date FROM x_need""")(
    lambda t: D.derive_needs(t.activity, t.line, t.price, t.rule("category_map")).select(
        "need_id", "fiscal_year", "source_activity", "source_task", "description", "category",
        "quantity", money("estimated_amount").alias("estimated_amount"),
        day("needed_by_date").alias("needed_by_date")))


@query("derive_pcc", """
WITH p AS (
  SELECT program, 'TASK' AS origin, work_date AS d, CAST(1 AS BIGINT) AS n, total AS a FROM x_lu
    WHERE execution_mode = 'DIRECT' AND line_status = 'O'
  UNION ALL SELECT program, 'PROCUREMENT', work_date, 3, total FROM x_lu
    WHERE execution_mode <> 'DIRECT' AND line_status = 'O'
  UNION ALL SELECT program, 'CONTRACT', pay_date, 2, amount FROM x_pay JOIN x_au USING (activity_id)),
g AS (SELECT program, origin, date_trunc('month', d) AS m, n, CAST(sum(a) * 100 AS BIGINT) AS c
  FROM p GROUP BY ALL),
s AS (SELECT *, unnest(range(0, n)) AS i FROM g)
SELECT program, origin, strftime(m + to_months(CAST(i AS INT)), '%Y-%m-%d') AS period,
  CAST(sum(CASE WHEN i = n - 1 THEN c - (n - 1) * (c // n) ELSE c // n END) AS DOUBLE) / 100 AS amount
FROM s GROUP BY ALL""")
def _(t):
    def first(c):
        return F.to_date(F.date_trunc("month", c)).alias("start")
    lu = t.line_unit.filter("line_status = 'O'")
    own = F.col("execution_mode") == "DIRECT"
    paid = t.payment.join(t.activity_unit.select("activity_id", "program"), "activity_id")
    out = D.derive_pcc(
        lu.filter(own).select("program", first("work_date"), F.lit(1).alias("months"),
                              F.col("total").alias("amount")),
        lu.filter(~own).select("program", first("work_date"), F.lit(3).alias("months"),
                               F.col("total").alias("amount")),
        paid.select("program", first("pay_date"), F.lit(2).alias("months"), "amount"), ["program"])
    return out.select("program", "origin", day("period").alias("period"),
                      money("amount").alias("amount"))


@query("generate_ppm", """
WITH g AS (SELECT category, authority_type, regime, label, fiscal_year, count(*) AS n_needs,
    sum(total) AS amount, min(work_date) AS needed FROM x_need GROUP BY ALL)
SELECT g.category, g.authority_type, g.regime, label, fiscal_year, n_needs,
  CAST(amount AS DOUBLE) AS estimated_amount, procedure, legal_source,
  CAST(CAST(needed - 135 AS DATE) AS VARCHAR) AS launch_by, 'AI_DRAFT' AS status
FROM g JOIN x_threshold r ON g.category = r.category AND g.authority_type = r.authority_type
  AND g.regime = r.regime AND amount >= lower_bound AND (upper_bound IS NULL OR amount < upper_bound)
  AND needed >= valid_from AND (valid_to IS NULL OR needed < valid_to)""")
def _(t):
    keys = ["category", "authority_type", "regime", "label", "fiscal_year"]
    out = D.generate_ppm(t.need, t.rule("threshold"), R.STAGE_DAYS, keys)
    return out.select(*keys, "n_needs", money("estimated_amount").alias("estimated_amount"),
                      "procedure", "legal_source", day("launch_by").alias("launch_by"), "status")


@query("baseline_plan", """
WITH c AS (SELECT budget_activity_id || '/' || execution_mode AS item, allocation, fiscal_year, status
  FROM x_act),
p AS (SELECT item, 1 AS rank, sum(allocation) AS amount FROM c WHERE status = 'IN_EXECUTION'
    AND fiscal_year = 2000 GROUP BY 1
  UNION ALL SELECT item, 2, sum(allocation) FROM c WHERE status = 'IN_PREPARATION' AND fiscal_year = 2000
    GROUP BY 1
  UNION ALL SELECT item, 3, max(a) FROM (SELECT item, sum(allocation) AS a, fiscal_year FROM c
    WHERE fiscal_year IN (1999, 2000) GROUP BY item, fiscal_year) GROUP BY item HAVING count(*) = 2
  UNION ALL SELECT DISTINCT owner || '/DIRECT', 4, CAST(0 AS DECIMAL(18,2)) FROM x_rec
    WHERE closed_ts IS NULL)
SELECT item, 2001 AS fiscal_year, ['COMMITMENT', 'ONGOING', 'RECURRENT', 'RECOMMENDATION'][min(rank)]
  AS origin, CAST(min(rank) AS INT) AS rank, CAST(max(amount) AS DOUBLE) AS amount FROM p GROUP BY item""")
def _(t):
    act = t.activity.withColumn("item", F.concat_ws("/", "budget_activity_id", "execution_mode"))
    def total(df):
        return df.groupBy("item").agg(F.sum("allocation").alias("amount"))
    last = act.filter("fiscal_year = 2000")
    two = act.filter("fiscal_year IN (1999, 2000)").groupBy("item", "fiscal_year").agg(
        F.sum("allocation").alias("_a")).groupBy("item").agg(
        F.max("_a").alias("amount"), F.count(F.lit(1)).alias("_n")).filter("_n = 2")
    open_recs = recommendations(t).filter(F.col("closed_on").isNull()).select(
        F.concat_ws("/", "owner", F.lit("DIRECT")).alias("item"), F.lit(0).alias("amount")).distinct()
    out = D.baseline_plan(two, total(last.filter("status = 'IN_EXECUTION'")),
                          total(last.filter("status = 'IN_PREPARATION'")), open_recs, 2001)
    return out.withColumn("amount", money("amount"))


query("new_year_rollover", """
SELECT program, fiscal_year, CAST(initial_ceiling AS DOUBLE) AS initial_ceiling,
  CAST(current_ceiling AS DOUBLE) AS current_ceiling, CAST(allocated AS DOUBLE) AS allocated FROM x_env
UNION ALL SELECT program, 2002, CAST(initial_ceiling AS DOUBLE), CAST(current_ceiling AS DOUBLE), 0.0
FROM x_env WHERE fiscal_year = 2001""")(
    lambda t: _doubles(D.new_year_rollover(t.envelope, 2002, ["initial_ceiling", "current_ceiling"])
                       .select("program", "fiscal_year", "initial_ceiling", "current_ceiling",
                               "allocated"), "initial_ceiling", "current_ceiling", "allocated"))


@query("scenario_overlay", """
WITH d AS (SELECT activity_id, allocation * 2 AS allocation, activity_id % 7 = 0 AS removed FROM x_act
  WHERE status = 'IN_PREPARATION')
SELECT activity_id, CAST(coalesce(d.allocation, a.allocation) AS DOUBLE) AS allocation,
  'OPTIMISTIC' AS scenario, d.activity_id IS NOT NULL AS overlaid
FROM x_act a LEFT JOIN d USING (activity_id) WHERE NOT coalesce(removed, FALSE)""")
def _(t):
    act = t.activity
    delta = act.filter("status = 'IN_PREPARATION'").select(
        "activity_id", (F.col("allocation") * 2).cast("decimal(18,2)").alias("allocation"),
        (F.col("activity_id") % 7 == 0).alias("removed"))
    return D.scenario_overlay(act, delta, "OPTIMISTIC", ["activity_id"], ["allocation"]).withColumn(
        "allocation", money("allocation"))


@query("scenario_reduce", """
SELECT 'REDUCED_10_PERCENT' AS scenario, activity_id,
  CAST(CAST(round(allocation * CAST(0.90 AS DECIMAL(3,2)), 2) AS DECIMAL(18,2)) AS DOUBLE)
  AS scenario_amount FROM x_act
UNION ALL SELECT 'PRIORITY_ONLY', activity_id, CAST(allocation AS DOUBLE) FROM x_act
WHERE priority IN ('1-URGENT', '2-HIGH')""")
def _(t):
    act = t.activity
    cut = D.scenario_reduce(act, "allocation", 10).withColumn("scenario", F.lit("REDUCED_10_PERCENT"))
    top = D.scenario_reduce(act, "allocation", 0, F.col("priority").isin("1-URGENT", "2-HIGH"))
    return cut.unionByName(top.withColumn("scenario", F.lit("PRIORITY_ONLY"))).select(
        "scenario", "activity_id", money("scenario_amount").alias("scenario_amount"))


@query("reallocate", """
WITH m AS (SELECT program || ':' || fiscal_year AS f, program || ':' || (fiscal_year + 1) AS t,
    sum(allocation) AS a FROM x_au WHERE status = 'IN_PREPARATION' AND fiscal_year < 2001 GROUP BY ALL),
c AS (SELECT k, sum(a) AS change FROM (SELECT f AS k, -a AS a FROM m UNION ALL SELECT t, a FROM m)
  GROUP BY 1)
SELECT program || ':' || fiscal_year AS envelope, CAST(available AS DOUBLE) AS available,
  CAST(coalesce(change, 0) AS DOUBLE) AS change,
  CAST(available + coalesce(change, 0) AS DOUBLE) AS available_after,
  available + coalesce(change, 0) < 0 AS overdrawn
FROM x_env LEFT JOIN c ON k = program || ':' || fiscal_year""")
def _(t):
    env = t.envelope.select(F.concat_ws(":", "program", "fiscal_year").alias("envelope"), "available")
    year = F.col("fiscal_year")
    moves = t.activity_unit.filter("status = 'IN_PREPARATION' AND fiscal_year < 2001").groupBy(
        F.concat_ws(":", "program", year).alias("from_key"),
        F.concat_ws(":", "program", year + 1).alias("to_key")).agg(F.sum("allocation").alias("amount"))
    return _doubles(D.reallocate(env, moves, "envelope"), "available", "change", "available_after")


@query("shift_schedule", """
WITH s AS (SELECT program, period, planned_amount AS a, CASE WHEN activity_id % 3 = 1 THEN 2 ELSE 0 END
  AS n FROM x_sched),
u AS (SELECT program, strftime(period, '%Y-%m') AS month, a AS b, 0 AS c FROM s
  UNION ALL SELECT program, strftime(period + to_months(n), '%Y-%m'), 0, a FROM s)
SELECT program, month, CAST(sum(b) AS DOUBLE) AS before, CAST(sum(c) AS DOUBLE) AS after
FROM u GROUP BY ALL""")
def _(t):
    shifts = t.activity.filter("execution_mode = 'INDIRECT'").select("activity_id",
                                                                    F.lit(2).alias("months"))
    return _doubles(D.shift_schedule(schedule(t), shifts, "activity_id", ["program"]), "before", "after")


#: institutions lose a tenth, some ministries gain three hundredths, some units a fixed amount
VIEWS["x_revision"] = """
  WITH a AS (SELECT u.institution_id, u.ministry_id, u.unit_id, sum(allocation) AS amount FROM x_act a
    JOIN x_unit u ON u.unit_id = a.budget_activity_id GROUP BY ALL)
  SELECT 'I:' || institution_id AS node, round(sum(amount) * CAST(-0.1 AS DECIMAL(2,1)), 2) AS change
    FROM a GROUP BY institution_id
  UNION ALL SELECT 'M:' || ministry_id, round(sum(amount) * CAST(0.03 AS DECIMAL(3,2)), 2) FROM a
    WHERE ministry_id % 5 = 0 GROUP BY ministry_id
  UNION ALL SELECT 'U:' || unit_id, CAST(100.01 AS DECIMAL(5,2)) FROM a WHERE unit_id % 7 = 0"""


@query("propagate_revision", """
WITH l AS (SELECT 'A:' || activity_id AS node, CAST(sum(allocation) * 100 AS HUGEINT) AS cents FROM x_act GROUP BY 1),
w AS (SELECT descendant, ancestor FROM x_below UNION SELECT child, child FROM x_tree
  UNION SELECT parent, parent FROM x_tree),
h AS (SELECT l.node, r.node AS revised, CAST(change * 100 AS HUGEINT) AS ch, cents,
    sum(cents) OVER (PARTITION BY r.node) AS al, sum(cents) OVER (PARTITION BY r.node ORDER BY l.node) AS upto
  FROM l JOIN w ON w.descendant = l.node JOIN x_revision r ON r.node = w.ancestor),
s AS (SELECT node, sum(sign(ch) * ((2 * abs(ch) * upto + al) // (2 * al)
    - (2 * abs(ch) * (upto - cents) + al) // (2 * al))) AS share FROM h GROUP BY 1),
k AS (SELECT descendant AS node, count(*) AS n FROM w JOIN x_revision r ON r.node = w.ancestor GROUP BY 1)
SELECT w.ancestor AS node, coalesce(any_value(n), 0) AS n_revisions, CAST(sum(cents) AS DOUBLE) / 100 AS before,
  CAST(sum(cents + coalesce(share, 0)) AS DOUBLE) / 100 AS after
FROM l JOIN w ON w.descendant = l.node LEFT JOIN s ON s.node = l.node LEFT JOIN k ON k.node = w.ancestor
GROUP BY 1 HAVING bool_or(share IS NOT NULL)""")
def _(t):
    own = t.activity.join(t.unit.select(F.col("unit_id").alias("budget_activity_id"), "ministry_id",
                                        "institution_id"), "budget_activity_id")
    per = own.groupBy("institution_id", "ministry_id", "budget_activity_id").agg(
        F.sum("allocation").alias("amount"))

    def revised(kind, key, rows, factor):
        return rows.groupBy(key).agg(F.round(F.sum("amount") * F.lit(factor).cast("decimal(3,2)"), 2)
                                     .cast("decimal(18,2)").alias("change")).select(
            F.concat_ws(":", F.lit(kind), key).alias("node"), "change")

    revisions = revised("I", "institution_id", per, "-0.1").unionByName(
        revised("M", "ministry_id", per.filter("ministry_id % 5 = 0"), "0.03")).unionByName(
        per.filter("budget_activity_id % 7 = 0").select(
            F.concat_ws(":", F.lit("U"), "budget_activity_id").alias("node"),
            F.lit("100.01").cast("decimal(18,2)").alias("change")))
    amounts = t.activity.select(F.concat_ws(":", F.lit("A"), "activity_id").alias("node"),
                                F.col("allocation").alias("amount"))
    out = D.propagate_revision(amounts, tree(t), revisions)
    return out.select("node", "n_revisions", money("before").alias("before"), money("after").alias("after"))


VIEWS["x_cline"] = """
  SELECT *, activity_id || ':' || supplier_id AS contract_number, row_number() OVER (
    PARTITION BY activity_id, supplier_id ORDER BY seq, resource_id, quantity, total, discount, tax,
      return_flag, line_status, work_date) AS pos FROM x_line"""


def contract_lines(t):
    order = [F.col(c) for c in FULL_ORDER if c != "supplier_id"]
    return windowed(t.line.withColumn("contract_number", F.concat_ws(
        ":", "activity_id", "supplier_id")), ["contract_number"], order, pos=("row_number",))


@query("contract_amendments", """
WITH a AS (SELECT contract_number, activity_id, supplier_id, pos, CAST(-round(discount * total, 2)
  AS DECIMAL(18,2)) AS ch FROM x_cline WHERE return_flag = 'A')
SELECT contract_number, row_number() OVER w AS amendment_no, CAST(ch AS DOUBLE) AS amount_change,
  CAST(c.award_amount + sum(ch) OVER w AS DOUBLE) AS amount_after,
  CAST(CAST(end_date + CAST(10 * row_number() OVER w AS INT) AS DATE) AS VARCHAR) AS end_after
FROM a JOIN x_contract c USING (contract_number) WINDOW w AS (PARTITION BY contract_number ORDER BY pos)""")
def _(t):
    amendments = contract_lines(t).filter("return_flag = 'A'").select(
        "contract_number", "pos", F.lit(10).alias("duration_change"),
        (-F.round(F.col("discount") * F.col("total"), 2)).cast("decimal(18,2)").alias("amount_change"))
    out = D.contract_amendments(amendments, t.contract, "contract_number", [F.col("pos")])
    return _doubles(out, "amount_change", "amount_after").withColumn("end_after", day("end_after"))


@query("contract_execution", f"""
WITH m AS (SELECT activity_id, supplier_id, count(*) AS n_milestones,
  count(*) FILTER (line_status = 'F' AND return_flag <> 'R') AS n_accepted,
  count(*) FILTER (return_flag = 'R') AS n_returned,
  count(*) FILTER (line_status <> 'F' AND return_flag <> 'R') AS n_pending FROM x_line GROUP BY ALL)
SELECT contract_number, n_milestones, n_accepted, n_returned, n_pending,
  CAST(CAST(end_date + 365 AS DATE) AS VARCHAR) AS guarantee_until,
  end_date + 365 BETWEEN DATE '{R.TODAY}' AND DATE '{R.TODAY}' + 60 AS guarantee_expiring
FROM x_contract JOIN m USING (activity_id, supplier_id)""")
def _(t):
    m = t.line.select(
        F.concat_ws(":", "activity_id", "supplier_id").alias("contract_number"),
        ((F.col("line_status") == "F") & (F.col("return_flag") != "R")).alias("done"),
        F.when(F.col("return_flag") == "R", "RETURNED").when(F.col("line_status") == "F", "ACCEPTED")
        .otherwise("PENDING").alias("reception"))
    return D.contract_execution(t.contract, m, R.TODAY, "contract_number").withColumn(
        "guarantee_until", day("guarantee_until"))


@query("failed_procurement", """
WITH a AS (SELECT activity_id, pos, supplier_id, total, work_date, return_flag,
  lead(work_date) OVER w AS nd, lead(total) OVER w AS na FROM x_seqline
  WINDOW w AS (PARTITION BY activity_id ORDER BY pos))
SELECT activity_id, pos AS attempt_no, cause, nd IS NOT NULL AS relaunched,
  CAST(date_diff('day', work_date, nd) AS INT) AS delay_days, CAST(na - total AS DOUBLE) AS amount_effect
FROM a JOIN x_cause_map ON cause_no = supplier_id % 6 WHERE return_flag = 'R'""")
def _(t):
    tries = windowed(t.line, ["activity_id"], [F.col(c) for c in FULL_ORDER],
                     attempt_no=("row_number",)).withColumn(
        "cause_no", (F.col("supplier_id") % 6).cast("int")).join(t.rule("cause_map"), "cause_no")
    attempts = tries.select("activity_id", "attempt_no", "cause", F.col("total").alias("amount"),
                            F.col("work_date").alias("attempt_date"),
                            (F.col("return_flag") == "R").alias("failed"))
    return _doubles(D.failed_procurement(attempts, "activity_id", [F.col("attempt_no")]),
                    "amount_effect")


_LOTS = {"ONE_LOT": ["category"], "BY_TERRITORY": ["category", "institution"],
         "BY_LABEL": ["category", "label"]}

query("compare_lots", " UNION ALL ".join(f"""
SELECT '{n}' AS scenario, count(*) AS n_lots, CAST(max(s) AS DOUBLE) AS largest_lot,
  CAST(sum(s) AS DOUBLE) AS amount, CAST(sum(b) AS DOUBLE) / count(*) AS mean_bidders
FROM (SELECT sum(total) AS s, count(DISTINCT supplier_id) AS b FROM x_need GROUP BY {', '.join(c)})"""
                                       for n, c in _LOTS.items()))(
    lambda t: _doubles(D.compare_lots(t.need, _LOTS), "largest_lot", "amount"))

query("project_packages", """
SELECT budget_activity_id, string_agg(DISTINCT category, ',' ORDER BY category) AS packages,
  count(DISTINCT category || '/' || activity_id || '/' || supplier_id) AS n_contracts,
  CAST(sum(total) AS DOUBLE) AS amount FROM x_need GROUP BY 1""")(
    lambda t: _doubles(D.project_packages(t.need, "budget_activity_id", "category").withColumn(
        "packages", F.array_join("packages", ",")), "amount"))


@query("cost_learning", """
SELECT resource_id, CAST(year(observed) AS INT) AS year, source, cents FROM x_points
UNION ALL SELECT resource_id, CAST(year(pay_date) AS INT), 'PAID',
  CAST((2 * sum(CAST(p.amount * 100 AS BIGINT)) + sum(quantity)) // (2 * sum(quantity)) AS BIGINT)
FROM (SELECT resource_id, work_date AS pay_date, quantity, CAST(round(total * (1 - discount), 2)
  AS DECIMAL(18,2)) AS amount FROM x_line WHERE line_status = 'F' AND return_flag <> 'R') p
GROUP BY 1, 2""")
def _(t):
    seen = price_points(t).select("resource_id", F.year("observed").alias("year"), "source", "cents")
    net = F.round(F.col("total") * (1 - F.col("discount")), 2).cast("decimal(18,2)")
    paid = t.line.filter("line_status = 'F' AND return_flag <> 'R'").select(
        "resource_id", F.year("work_date").alias("year"), (net * 100).cast("long").alias("cents"),
        "quantity")
    return D.cost_learning(seen, paid)
