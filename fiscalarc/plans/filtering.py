"""Queries of projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import day, money
from ..operators import filters as O
from ..sources import rules as R
from .ingestion import history
from .registry import VIEWS, query

query("to_canonical", """
SELECT o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS code, o_custkey AS budget_activity_id,
  CAST(o_totalprice AS DOUBLE) AS amount FROM orders""")(
    lambda t: O.to_canonical(t.raw("orders"), {
        "o_orderkey": ("id", "bigint"), "o_custkey": ("budget_activity_id", "bigint"),
        "o_totalprice": ("amount", "double")}).withColumn("code", F.col("id").cast("string")))

query("cost_lines", """
SELECT activity_id, seq, resource_id, CAST(CAST(((CAST(total * 100 AS HUGEINT)
  * CAST((1 - discount) * 100 AS HUGEINT) * CAST((1 + tax) * 100 AS HUGEINT) + 5000) // 10000)
  AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DOUBLE) AS cost FROM x_line""")(
    lambda t: O.cost_lines(t.line).select("activity_id", "seq", "resource_id",
                                          money("cost").alias("cost")))

query("price_search", """
SELECT resource_id, label, brand, CAST(ref_price AS DOUBLE) AS price FROM x_price
WHERE label LIKE '%gear%' AND resource_type = 'ECONOMY' AND ref_price BETWEEN 905 AND 995""")(
    lambda t: O.price_search(t.price, label="gear", category="ECONOMY", low="905", high="995")
    .select("resource_id", "label", "brand", money("ref_price").alias("price")))

query("split_execution_mode", """
SELECT execution_mode, CASE execution_mode WHEN 'DIRECT' THEN 'INTERNAL' WHEN 'INDIRECT'
  THEN 'EXTERNAL' ELSE CASE WHEN total < 20000 THEN 'INTERNAL' ELSE 'EXTERNAL' END END AS component,
  count(*) AS n, CAST(sum(total) AS DOUBLE) AS amount FROM x_la GROUP BY ALL""")(
    lambda t: O.split_execution_mode(t.line_activity, F.col("total") < 20000)
    .groupBy("execution_mode", "component").agg(F.count(F.lit(1)).alias("n"),
                                                money(F.sum("total")).alias("amount")))

query("tenant_filter", """
SELECT activity_id, institution, CAST(allocation AS DOUBLE) AS allocation FROM x_au
WHERE institution_id = 2""")(
    lambda t: O.tenant_filter(t.activity_unit, 2, "institution_id").select(
        "activity_id", "institution", money("allocation").alias("allocation")))

query("mask_columns", """
SELECT activity_id, data_class, CASE WHEN level <= 2 THEN CAST(allocation AS DOUBLE) END
  AS allocation, substr(sha256(CAST(budget_activity_id AS VARCHAR)), 1, 16) AS budget_activity_id
FROM x_act JOIN x_data_class USING (priority)""")(
    lambda t: O.mask_columns(
        t.activity.join(t.rule("data_class"), "priority"), F.col("level"), 2, ["allocation"],
        ["budget_activity_id"]).select("activity_id", "data_class",
                                       money("allocation").alias("allocation"),
                                       "budget_activity_id"))


@query("effective_permission", """
WITH u AS (SELECT actor % 5 AS tenant, list(DISTINCT k % 5) AS user_tools FROM x_ev
  WHERE value > 150 GROUP BY 1),
g AS (SELECT kind AS agent, list(DISTINCT k % 5) AS agent_tools FROM x_ev WHERE value > 200 GROUP BY 1),
j AS (SELECT e.event_id, e.k % 5 AS tool, coalesce(list_intersect(list_intersect(user_tools,
  agent_tools), [0, 1, 3]), []) AS usable
  FROM x_ev e LEFT JOIN u ON u.tenant = e.actor % 5 LEFT JOIN g ON g.agent = e.kind)
SELECT event_id, tool, CAST(len(usable) AS INT) AS n_usable, list_contains(usable, tool) AS allowed
FROM j""")
def _(t):
    ev = t.event.select("event_id", (F.col("actor") % 5).alias("tenant"), F.col("kind").alias("agent"),
                        (F.col("k") % 5).alias("tool"), "value")
    def tools(key, above):  # at most five tools exist, so the sets stay tiny
        return ev.filter(F.col("value") > above).groupBy(key).agg(
            F.collect_set("tool").alias("user_tools" if key == "tenant" else "agent_tools"))
    out = O.effective_permission(ev, tools("tenant", 150), tools("agent", 200), [0, 1, 3])
    return out.select("event_id", "tool", "n_usable", "allowed")


query("secure_results", """
SELECT doc_id, lang, rank FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang
  ORDER BY n_chars DESC, doc_id) AS rank FROM documents
  WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) WHERE rank <= 5""")(
    lambda t: O.secure_results(t.document.select("doc_id", "lang", "n_chars"),
                               t.raw("labels").filter("quality = 1"), "doc_id", ["lang"],
                               [F.desc("n_chars"), F.col("doc_id")], 5)
    .select("doc_id", "lang", "rank"))

query("valid_at", """
SELECT object_id, activity_id, version FROM x_hist
WHERE valid_from <= DATE '2000-02-29' AND (valid_to IS NULL OR valid_to > DATE '2000-02-29')""")(
    lambda t: O.valid_at(history(t), "2000-02-29").select("object_id", "activity_id", "version"))

VIEWS["x_legal"] = """
  SELECT doc_id, lang AS jurisdiction, coalesce(quality, 0) = 1 AS official,
    CAST(DATE '1995-01-01' + CAST(doc_id % 2000 AS INT) AS DATE) AS valid_from,
    CASE WHEN doc_id % 2 = 0 THEN CAST(DATE '1995-01-01' + CAST(doc_id % 2000 + 400 AS INT) AS DATE)
      END AS valid_to FROM documents LEFT JOIN labels USING (doc_id)"""


def legal_texts(t):
    start = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("doc_id") % 2000).cast("int"))
    return t.document.select("doc_id", "lang").join(
        t.raw("labels").select("doc_id", "quality"), "doc_id", "left").select(
        "doc_id", F.col("lang").alias("jurisdiction"),
        (F.coalesce("quality", F.lit(0)) == 1).alias("official"), start.alias("valid_from"),
        F.when(F.col("doc_id") % 2 == 0, F.date_add(start, 400)).alias("valid_to"))


query("regulatory_filter", """
SELECT doc_id, CAST(valid_from AS VARCHAR) AS valid_from FROM x_legal WHERE jurisdiction = 'fr'
AND official AND valid_from <= DATE '1996-06-01' AND (valid_to IS NULL OR valid_to > DATE '1996-06-01')
""")(lambda t: O.regulatory_filter(legal_texts(t), "1996-06-01", "fr").select(
    "doc_id", day("valid_from").alias("valid_from")))

query("official_only", """
SELECT activity_id, 'OFFICIAL' AS label FROM x_act WHERE status IN ('CLOSED', 'IN_EXECUTION')""")(
    lambda t: O.official_only(t.activity, "status", ("CLOSED", "IN_EXECUTION")).select(
        "activity_id", "label"))

query("retention_expired", f"""
SELECT activity_id, data_class, CAST(CAST(start_date + days AS DATE) AS VARCHAR) AS expired_on
FROM x_act JOIN x_data_class USING (priority) JOIN x_retention USING (data_class)
WHERE start_date + days < DATE '{R.TODAY}'""")(
    lambda t: O.retention_expired(t.activity.join(t.rule("data_class"), "priority"),
                                  t.rule("retention"), R.TODAY, "start_date").select(
        "activity_id", "data_class", day("expired_on").alias("expired_on")))


def line_rules():
    return {"quantity_over_45": F.col("quantity") > 45,
            "discount_at_limit": F.col("discount") == F.lit("0.10").cast("decimal(4,2)"),
            "work_before_start": F.col("work_date") < F.col("start_date")}


query("quarantine", """
SELECT activity_id, seq, resource_id, concat_ws(',', CASE WHEN quantity > 45 THEN 'quantity_over_45'
  END, CASE WHEN discount = 0.1 THEN 'discount_at_limit' END,
  CASE WHEN work_date < start_date THEN 'work_before_start' END) AS reasons FROM x_la
WHERE quantity > 45 OR discount = 0.1 OR work_date < start_date""")(
    lambda t: O.quarantine(t.line_activity, line_rules())[1].select(
        "activity_id", "seq", "resource_id", F.array_join("reasons", ",").alias("reasons")))

query("bulk_edit", """
SELECT activity_id, priority = '5-LOW' AND status = 'IN_PREPARATION' AS changed,
  CAST(allocation AS DOUBLE) AS allocation,
  CAST(CASE WHEN priority = '5-LOW' AND status = 'IN_PREPARATION'
    THEN CAST(round(allocation * CAST(0.9 AS DECIMAL(2,1)), 2) AS DECIMAL(18,2)) ELSE allocation END AS DOUBLE)
    AS allocation_after FROM x_act""")(
    lambda t: O.bulk_edit(
        t.activity, (F.col("priority") == "5-LOW") & (F.col("status") == "IN_PREPARATION"),
        {"allocation": F.round(F.col("allocation") * F.lit("0.9").cast("decimal(2,1)"), 2)
         .cast("decimal(18,2)")}).select("activity_id", "changed",
                                         money("allocation").alias("allocation"),
                                         money("allocation_after").alias("allocation_after")))
