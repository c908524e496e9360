"""Queries of sources, sinks and ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import day, money
from ..operators.windows import build_scd2
from ..session import work_dir
from ..sources import ingest as I
from .registry import VIEWS, query

query("read_canonical", """
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem""")(
    lambda t: I.read_canonical(t.spark, t.path, "lineitem",
                               ["l_orderkey", "l_linenumber", "l_extendedprice"]))


@query("import_tabular", """
SELECT reason, count(*) AS n_rows, CAST(sum(activity) AS BIGINT) AS key_sum FROM (
 SELECT o_orderkey AS activity, CASE WHEN o_orderpriority = '5-LOW' AND o_totalprice < 100000
   THEN 'unreadable value,amount under minimum' WHEN o_orderpriority = '5-LOW'
   THEN 'unreadable value' WHEN o_totalprice < 100000 THEN 'amount under minimum' ELSE 'ok' END
   AS reason FROM orders) GROUP BY 1""")
def _(t):
    # the activities leave as CSV with one unreadable column value per low-priority row
    path = work_dir(t.spark, "import")
    (t.raw("orders").select(
        F.col("o_orderkey").alias("Activity No"), F.col("o_totalprice").alias("Amount"),
        F.when(F.col("o_orderpriority") == "5-LOW", "n/a").otherwise(
            day("o_orderdate")).alias("Start"))
     .write.option("header", True).csv(path))
    ok, bad = I.import_tabular(
        t.spark, path, {"Activity No": ("activity", "bigint"), "Amount": ("amount", "double"),
                        "Start": ("start_date", "date")},
        {"amount under minimum": F.col("amount") < 100000})
    tagged = ok.select("activity", F.lit("ok").alias("reason")).unionByName(
        bad.select("activity", F.array_join("reasons", ",").alias("reason")))
    return tagged.groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows"),
                                        F.sum("activity").alias("key_sum"))


query("import_api_payload", """
SELECT event_id, CAST(props->>'$.k' AS INT) AS k FROM events""")(
    lambda t: I.import_api_payload(t.raw("events").select("event_id", "props"), "props", "k int"))

VIEWS["x_act2"] = """
  SELECT CASE activity_id % 10 WHEN 3 THEN activity_id + 10000000 ELSE activity_id END
      AS activity_id, budget_activity_id, allocation, start_date FROM x_act
    WHERE activity_id % 10 = 3
  UNION ALL SELECT activity_id, budget_activity_id,
    CASE activity_id % 10 WHEN 1 THEN CAST(round(allocation * CAST(1.1 AS DECIMAL(2,1)), 2) AS DECIMAL(18,2))
      ELSE allocation END,
    CASE activity_id % 10 WHEN 2 THEN CAST(start_date + 30 AS DATE) ELSE start_date END
    FROM x_act WHERE activity_id % 10 <> 0"""


def second_version(t):
    """Version 2 of the plan: some rows removed, repriced, moved or copied."""
    act = t.activity.select("activity_id", "budget_activity_id", "allocation", "start_date",
                            "execution_mode")
    digit = F.col("activity_id") % 10
    raised = F.round(F.col("allocation") * F.lit("1.1").cast("decimal(2,1)"), 2).cast(
        "decimal(18,2)")
    kept = act.filter(digit != 0).select(
        "activity_id", "budget_activity_id",
        F.when(digit == 1, raised).otherwise(F.col("allocation")).alias("allocation"),
        F.when(digit == 2, F.date_add("start_date", 30)).otherwise(F.col("start_date"))
        .alias("start_date"), "execution_mode")
    added = act.filter(digit == 3).withColumn("activity_id", F.col("activity_id") + 10_000_000)
    return kept.unionByName(added)


@query("apply_cdc", """
SELECT activity_id, budget_activity_id, CAST(allocation AS DOUBLE) AS allocation,
  CAST(start_date AS VARCHAR) AS start_date FROM x_act2""")
def _(t):
    columns = ["activity_id", "budget_activity_id", "allocation", "start_date"]
    base, target = t.activity.select(*columns), second_version(t).select(*columns)
    digit = F.col("activity_id") % 10
    first = target.filter(digit.isin(1, 2, 3)).withColumn(
        "allocation", F.lit(0).cast("decimal(18,2)")).withColumn("op", F.lit("U")).withColumn(
        "change_no", F.lit(1))
    last = target.filter(digit.isin(1, 2, 3) ).withColumn("op", F.lit("U")).withColumn(
        "change_no", F.lit(2))
    gone = base.filter(digit == 0).withColumn("op", F.lit("D")).withColumn("change_no", F.lit(3))
    feed = first.unionByName(last).unionByName(gone)
    out = I.apply_cdc(base, feed, ["activity_id"], "change_no")
    return out.withColumn("allocation", money("allocation")).withColumn(
        "start_date", day("start_date"))


@query("read_events", """
SELECT kind, count(*) AS n, CAST(sum(value) AS DOUBLE) AS amount FROM x_ev GROUP BY 1""")
def _(t):
    stream = I.read_events(t.spark, f"{t.path}/events.parquet")
    target = work_dir(t.spark, "events")
    I.run_available(stream, target, work_dir(t.spark, "cp"))
    return (t.spark.read.schema(stream.schema).parquet(target)
            .groupBy(F.col("event_type").alias("kind"))
            .agg(F.count(F.lit(1)).alias("n"),
                 money(F.sum(F.col("value").cast("decimal(18,2)"))).alias("amount")))


query("read_documents", """
SELECT doc_id AS document_id, lang, source, sha256(text) AS hash,
  CAST(strlen(text) AS INT) AS n_bytes FROM documents""")(
    lambda t: I.read_documents(t.document, "text", "doc_id").select(
        "document_id", "lang", "source", "hash", "n_bytes"))


@query("promote_zone", """
SELECT fiscal_year, 2 * count(*) AS n_raw, count(*) AS n_curated,
  CAST(sum(allocation) AS DOUBLE) AS amount FROM x_act GROUP BY 1""")
def _(t):
    root = work_dir(t.spark, "zones")
    for _ in range(2):  # the raw zone keeps both deliveries
        raw = I.promote_zone(t.activity, root, "activity", "RAW", ["fiscal_year"])
    read = t.spark.read.parquet
    curated = I.promote_zone(read(raw).dropDuplicates(["activity_id"]), root, "activity",
                             "CURATED", ["fiscal_year"])
    a = read(raw).groupBy("fiscal_year").agg(F.count(F.lit(1)).alias("n_raw"))
    b = read(curated).groupBy("fiscal_year").agg(F.count(F.lit(1)).alias("n_curated"),
                                                 money(F.sum("allocation")).alias("amount"))
    return a.join(b, "fiscal_year")


query("check_contract", """
SELECT unnest(['schema', 'not_null:activity_id', 'not_null:start_date', 'freshness', 'version'])
    AS clause,
  unnest([TRUE, n1 = 0, n2 = 0, newest >= DATE '2001-01-01', other = 0]) AS passed,
  unnest(['', CAST(n1 AS VARCHAR), CAST(n2 AS VARCHAR), CAST(newest AS VARCHAR),
    CAST(other AS VARCHAR)]) AS observed
FROM (SELECT count(*) FILTER (activity_id IS NULL) AS n1, count(*) FILTER (start_date IS NULL) AS n2,
  max(start_date) AS newest, count(*) FILTER (fiscal_year <> 2000) AS other FROM x_act)""")(
    lambda t: I.check_contract(t.activity, {
        "columns": {"activity_id": "bigint", "allocation": "decimal(18,2)", "start_date": "date"},
        "not_null": ["activity_id", "start_date"], "fresh": ("start_date", "2001-01-01"),
        "version": ("fiscal_year", 2000)}))


@query("check_metadata", """
SELECT doc_id AS asset, concat_ws(',', CASE WHEN n_chars < 100 THEN 'owner' END,
  CASE WHEN quality IS NULL THEN 'classification' END, CASE WHEN toxic = 1 THEN 'retention' END)
  AS missing FROM documents LEFT JOIN labels USING (doc_id)
WHERE n_chars < 100 OR quality IS NULL OR toxic = 1""")
def _(t):
    catalog = t.document.join(t.raw("labels"), "doc_id", "left").select(
        F.col("doc_id").alias("asset"), "source",
        F.when(F.col("n_chars") >= 100, F.col("source")).alias("owner"),
        F.col("lang").alias("schema"), F.col("quality").alias("classification"),
        F.when(F.coalesce("toxic", F.lit(0)) == 0, 365).alias("retention"))
    return I.check_metadata(catalog, "asset")


@query("export_dataset", """
SELECT status, count(*) AS n, CAST(sum(allocation) AS DOUBLE) AS amount FROM x_act
WHERE status <> 'IN_PREPARATION' GROUP BY 1""")
def _(t):
    path = I.export_dataset(t.activity, "json", work_dir(t.spark, "export"),
                            F.col("status") != "IN_PREPARATION")
    schema = "activity_id bigint, status string, allocation decimal(18,2)"
    return t.spark.read.schema(schema).json(path).groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), money(F.sum("allocation")).alias("amount"))


VIEWS["x_hist"] = """
  SELECT budget_activity_id AS object_id, activity_id, allocation, status, start_date AS valid_from,
    lead(start_date) OVER w AS valid_to, row_number() OVER w AS version,
    lag(activity_id) OVER w AS supersedes_id
  FROM x_act WINDOW w AS (PARTITION BY budget_activity_id ORDER BY start_date, activity_id)"""


def history(t):
    return build_scd2(t.activity.select(F.col("budget_activity_id").alias("object_id"),
                                        "activity_id", "allocation", "status", "start_date"),
                      "object_id", "start_date", "activity_id")


query("snapshot_as_of", """
SELECT object_id, activity_id, CAST(allocation AS DOUBLE) AS allocation, status FROM x_hist
WHERE valid_from <= DATE '1998-06-30' AND (valid_to IS NULL OR valid_to > DATE '1998-06-30')""")(
    lambda t: I.snapshot_as_of(history(t), "1998-06-30").select(
        "object_id", "activity_id", money("allocation").alias("allocation"), "status"))


@query("backfill_year", """
SELECT fiscal_year, count(*) AS n, CAST(sum(allocation) AS DOUBLE) AS amount FROM x_act GROUP BY 1""")
def _(t):
    path = work_dir(t.spark, "backfill")
    years = sorted(r[0] for r in t.activity.select("fiscal_year").distinct().collect())
    for year in (*years, *years[:1]):  # repeating a year must not duplicate it
        I.backfill_year(t.activity, year, path)
    return t.spark.read.parquet(path).groupBy("fiscal_year").agg(
        F.count(F.lit(1)).alias("n"), money(F.sum("allocation")).alias("amount"))


query("dataset_fingerprint", """
SELECT lang, count(*) AS n_rows, CAST(sum(CAST('0x' || substr(md5(
  coalesce(length(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-')
  || coalesce(length(text) || ':' || text, '-')), 1, 15) AS BIGINT)) AS VARCHAR) AS fingerprint
FROM documents GROUP BY 1""")(
    lambda t: I.dataset_fingerprint(t.document, ["doc_id", "text"], ["lang"]))
