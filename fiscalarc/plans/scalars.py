"""Queries of scalar functions and content checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.columns import day, money, tokens
from ..operators import content as X
from ..operators import derive as D
from ..sources import rules as R
from .inputs import risks
from .registry import VIEWS, query

_NORM = (f"trim(regexp_replace(regexp_replace(translate(lower(text), '{C.ACCENTS}', '{C.PLAIN}'), "
         "'[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))")
VIEWS["x_words"] = """SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS words
  FROM documents"""

query("normalise_label", f"""
SELECT doc_id, md5({_NORM}) AS label_hash, length({_NORM}) AS n FROM documents""")(
    lambda t: t.document.withColumn("_l", C.normalise_label("text")).select(
        "doc_id", F.md5("_l").alias("label_hash"), F.length("_l").alias("n")))

query("extract_keywords", """
SELECT doc_id, md5(array_to_string(list_sort(list_distinct(list_filter(words,
  lambda w: length(w) >= 4))), ' ')) AS keywords_hash,
  len(list_distinct(list_filter(words, lambda w: length(w) >= 4))) AS n FROM x_words""")(
    lambda t: t.document.withColumn("_k", C.extract_keywords("text")).select(
        "doc_id", F.md5(F.array_join("_k", " ")).alias("keywords_hash"), F.size("_k").alias("n")))

_FREQ = {"DAILY": "day", "WEEKLY": "week", "MONTHLY": "month", "QUARTERLY": "quarter",
         "ANNUAL": "year"}


@query("period_bucket", f"""
WITH b AS (SELECT start_date, allocation, unnest([{', '.join(f"'{f}'" for f in _FREQ)}, 'SEMI_ANNUAL'])
  AS frequency FROM x_act),
p AS (SELECT frequency, allocation, CASE frequency {' '.join(
    f"WHEN '{f}' THEN CAST(date_trunc('{u}', start_date) AS DATE)" for f, u in _FREQ.items())}
  ELSE make_date(year(start_date), CASE WHEN month(start_date) <= 6 THEN 1 ELSE 7 END, 1) END AS d FROM b)
SELECT frequency, CAST(d AS VARCHAR) AS period, count(*) AS n, CAST(sum(allocation) AS DOUBLE) AS amount
FROM p GROUP BY ALL""")
def _(t):
    daily = t.activity.groupBy("start_date").agg(F.count(F.lit(1)).alias("_n"),
                                                 F.sum("allocation").alias("_a"))
    rows = daily.select("_n", "_a", F.explode(F.array(*[
        F.struct(F.lit(f).alias("frequency"), C.period_bucket("start_date", f).alias("period"))
        for f in (*_FREQ, "SEMI_ANNUAL")])).alias("x")).select("_n", "_a", "x.*")
    return rows.groupBy("frequency", "period").agg(
        F.sum("_n").alias("n"), money(F.sum("_a")).alias("amount")).withColumn(
        "period", day("period"))


query("calendar_fields", """
WITH l AS (SELECT activity_id, min(work_date) AS a, max(work_date) AS b FROM x_line GROUP BY 1)
SELECT activity_id, (SELECT string_agg(year(q) || 'Q' || quarter(q), ',' ORDER BY q)
  FROM (SELECT unnest(generate_series(date_trunc('quarter', a), CAST(b AS TIMESTAMP),
    INTERVAL 3 MONTHS)) AS q)) AS quarters FROM l""")(
    lambda t: t.line.groupBy("activity_id").agg(
        F.min("work_date").alias("a"), F.max("work_date").alias("b")).select(
        "activity_id", F.array_join(C.calendar_fields("a", "b"), ",").alias("quarters")))


@query("reverse_schedule", """
SELECT activity_id, seq, resource_id, CAST(work_date - 165 AS VARCHAR) AS preparation_by,
  CAST(work_date - 135 AS VARCHAR) AS launch_by, CAST(work_date - 85 AS VARCHAR) AS award_by,
  CAST(work_date - 60 AS VARCHAR) AS delivery_by, 165 AS total_days FROM x_need""".replace(
    "CAST(work_date - 165 AS VARCHAR)", "CAST(CAST(work_date - 165 AS DATE) AS VARCHAR)"))
def _(t):
    out = D.reverse_schedule(t.need, R.STAGE_DAYS, "work_date")
    return out.select("activity_id", "seq", "resource_id", *[
        day(f"{s}_by").alias(f"{s}_by") for s in ("preparation", "launch", "award", "delivery")],
        "total_days")


@query("spread_schedule", """
WITH a AS (SELECT activity_id, CAST(allocation * 100 AS BIGINT) AS c, CAST(1 + activity_id % 6 AS BIGINT)
    AS n, date_trunc('month', start_date) AS m FROM x_act),
s AS (SELECT *, unnest(range(0, n)) AS i FROM a)
SELECT activity_id, strftime(m + to_months(CAST(i AS INT)), '%Y-%m-%d') AS period,
  CAST(CAST(CASE WHEN i = n - 1 THEN c - (n - 1) * (c // n) ELSE c // n END AS DECIMAL(20,0))
    * CAST(0.01 AS DECIMAL(3,2)) AS DOUBLE) AS planned_amount FROM s""")
def _(t):
    facts = t.activity.select("activity_id", "start_date", "allocation",
                              (1 + F.col("activity_id") % 6).alias("months"))
    return D.spread_schedule(facts, "start_date", "months", "allocation").select(
        "activity_id", day("period").alias("period"), money("planned_amount").alias("planned_amount"))


@query("array_fields", """
WITH n AS (SELECT category, label, authority_type, activity_id || '-' || resource_id AS need_id,
  funding_source FROM x_need),
d AS (SELECT DISTINCT category, label, authority_type, need_id FROM n),
r AS (SELECT *, (row_number() OVER (PARTITION BY category, label, authority_type ORDER BY need_id) - 1)
  // 1000 AS page FROM d),
p AS (SELECT category, label, authority_type, page, count(*) AS n_needs, min(need_id) AS first_need
  FROM r GROUP BY ALL),
f AS (SELECT category, label, authority_type, string_agg(DISTINCT funding_source, ',' ORDER BY
  funding_source) AS funding_sources, bool_or(funding_source = 'Loan') AS uses_loan FROM n GROUP BY ALL)
SELECT * FROM p JOIN f USING (category, label, authority_type)""")
def _(t):
    items = t.need.withColumn("need_id", F.concat_ws("-", "activity_id", "resource_id"))
    out = X.array_fields(items, ["category", "label", "authority_type"])
    return out.select("category", "label", "authority_type", "page", "n_needs", "first_need",
                      F.array_join("funding_sources", ",").alias("funding_sources"), "uses_loan")


query("map_fields", """
SELECT dimension, member, count(*) AS n FROM (
  SELECT unnest(['sex', 'tool', 'kind']) AS dimension,
    unnest([CASE WHEN k % 2 = 0 THEN 'F' ELSE 'M' END, CAST(k % 5 AS VARCHAR), kind]) AS member
  FROM x_ev) GROUP BY ALL""")(
    lambda t: X.map_fields(t.event, ["event_id"],
                           sex=F.when(F.col("k") % 2 == 0, "F").otherwise("M"),
                           tool=F.col("k") % 5, kind=F.col("kind"))
    .groupBy("dimension", "member").agg(F.count(F.lit(1)).alias("n")))

query("parse_payload", """
SELECT event_id, CAST(props->>'$.k' AS INT) AS k, (props->>'$.absent') IS NULL AS absent
FROM events""")(
    lambda t: t.raw("events").withColumn("p", X.parse_payload("props", "k int, absent string")).select(
        "event_id", "p.k", F.col("p.absent").isNull().alias("absent")))


@query("validate_proposals", """
WITH g AS (SELECT DISTINCT actor % 5 AS tenant, k % 5 AS tool FROM x_ev WHERE value > 160),
p AS (SELECT event_id AS proposal_id, actor % 5 AS tenant, kind AS action, value AS amount, k % 5 AS tool,
  k % 10 = 9 AS broken FROM x_ev),
j AS (SELECT p.*, g.tenant IS NOT NULL AS granted, r.approver FROM p
  LEFT JOIN g ON g.tenant = p.tenant AND g.tool = p.tool LEFT JOIN x_action_rule r ON r.kind = p.action),
v AS (SELECT *, CASE WHEN broken THEN 'schema' ELSE concat_ws(',', CASE WHEN NOT granted THEN 'permission'
  END, CASE WHEN amount > 100 THEN 'amount over limit' END) END AS reasons FROM j)
SELECT proposal_id, CASE WHEN NOT broken THEN action END AS action,
  CASE WHEN reasons <> '' THEN 'REJECTED' WHEN approver IS NOT NULL THEN 'NEEDS_APPROVAL'
    ELSE 'ACCEPTED' END AS verdict, reasons,
  CASE WHEN reasons = '' THEN approver END AS approver FROM v""")
def _(t):
    ev = t.event.withColumn("tenant", F.col("actor") % 5).withColumn("tool", F.col("k") % 5)
    grants = ev.filter("value > 160").select("tenant", "tool").distinct()
    payload = F.to_json(F.struct(F.col("kind").alias("action"), F.col("value").alias("amount"), "tool"))
    proposals = ev.select(F.col("event_id").alias("proposal_id"), "tenant",
                          F.when(F.col("k") % 10 == 9, F.concat(F.lit("<"), payload))
                          .otherwise(payload).alias("payload"))
    return X.validate_proposals(proposals, grants, t.rule("action_rule"), "100")


query("action_risk", """
SELECT event_id, risk_class, approver FROM x_ev JOIN x_action_rule USING (kind)""")(
    lambda t: X.action_risk(t.event.select("event_id", "kind"), t.rule("action_rule")).select(
        "event_id", "risk_class", "approver"))

query("risk_score", """
SELECT event_id, (1 + actor % 5) * (1 + k % 5) AS score, CASE WHEN (1 + actor % 5) * (1 + k % 5) >= 15
  THEN 'CRITICAL' WHEN (1 + actor % 5) * (1 + k % 5) >= 8 THEN 'WARNING' ELSE 'INFO' END AS severity
FROM x_ev""")(lambda t: X.risk_score(risks(t)).select("event_id", "score", "severity"))


def metric_base(t):
    cents = (F.col("total") * 100).cast("long")
    return t.line_unit.groupBy("program").agg(
        F.sum(cents).alias("gross_cents"), F.sum("quantity").alias("quantity"),
        F.sum((F.col("total") * F.col("discount") * 10000).cast("long")).alias("_d"),
        F.count_if(F.col("line_status") == "F").alias("closed_lines"),
        F.count(F.lit(1)).alias("n_lines")).withColumn("discount_cents", F.col("_d") / 100)


query("formula_metric", """
SELECT program, (CAST(sum(CAST(total * discount * 10000 AS BIGINT)) AS DOUBLE) / 100)
    / CAST(sum(CAST(total * 100 AS BIGINT)) AS DOUBLE) AS discount_rate,
  CAST(sum(CAST(total * 100 AS BIGINT)) AS DOUBLE) / CAST(sum(quantity) AS DOUBLE) AS unit_cost,
  CAST(count(*) FILTER (line_status = 'F') AS DOUBLE) / count(*) AS closed_share
FROM x_lu GROUP BY program""")(
    lambda t: X.formula_metric(metric_base(t), R.TABLES["metric"][1]).select(
        "program", "discount_rate", "unit_cost", "closed_share"))

_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"


# the rule terms, and of each benchmark text its first one to six words
@query("glossary_tag", f"""
WITH b AS (SELECT {_WORDS.format("text")} AS w FROM benchmark),
g AS (SELECT term FROM x_glossary UNION SELECT array_to_string(w[1:1 + len(w) % 6], ' ') FROM b),
t AS (SELECT p, n, min(term) AS term FROM (SELECT term, array_to_string(w, ' ') AS p, len(w) AS n FROM (
    SELECT term, {_WORDS.format("term")} AS w FROM g)) WHERE n > 0 GROUP BY p, n),
k AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM x_words),
d AS (SELECT doc_id, i, [w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o,
    lead(w, 5) OVER o] AS w FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
m AS (SELECT doc_id, i, t.n, term FROM (SELECT doc_id, i, n, array_to_string(w[1:n], ' ') AS p
    FROM d, range(1, 7) r(n) WHERE w[n] IS NOT NULL) x JOIN t ON t.p = x.p AND t.n = x.n)
SELECT doc_id, term, count(*) AS n FROM m WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.doc_id = m.doc_id
  AND b.i <= m.i AND b.i + b.n >= m.i + m.n AND b.n > m.n) GROUP BY ALL""")
def _(t):
    words = tokens("text")
    phrases = t.raw("benchmark").select(F.array_join(F.slice(words, F.lit(1), 1 + F.size(words) % 6), " ").alias("term"))
    return X.glossary_tag(t.document, t.rule("glossary").select("term").unionByName(phrases), "doc_id", "text")


_S = X.SENSITIVE
query("classify_sensitivity", f"""
SELECT doc_id, CASE WHEN regexp_matches(lower(text), '{_S["CRITICAL"]}') THEN 'CRITICAL'
  WHEN regexp_matches(lower(text), '{_S["CONFIDENTIAL"]}') THEN 'CONFIDENTIAL'
  WHEN regexp_matches(lower(text), '{_S["RESTRICTED"]}') THEN 'RESTRICTED' ELSE 'PUBLIC' END AS data_class
FROM documents""")(
    lambda t: X.classify_sensitivity(t.document, "text").select("doc_id", "data_class"))

_VIS = (r"trim(regexp_replace(regexp_replace(regexp_replace(lower(html), "
        r"'(?s)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))")
query("flag_untrusted", f"""
WITH v AS (SELECT page_id, {_VIS} AS visible FROM pages)
SELECT page_id, md5(visible) AS visible_hash, {' + '.join(
    f"CAST(regexp_matches(visible, '{p}') AS INT)" for p in X.INSTRUCTIONS)} AS n_patterns,
  {' OR '.join(f"regexp_matches(visible, '{p}')" for p in X.INSTRUCTIONS)} AS carries_instructions
FROM v""")(
    lambda t: X.flag_untrusted(t.raw("pages"), "html").select(
        "page_id", F.md5("visible").alias("visible_hash"), "n_patterns", "carries_instructions"))
