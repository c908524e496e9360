"""Queries of the user-function surface."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import userfunctions as U
from ..functions.columns import weighted_progress
from ..sources import rules as R
from .inputs import milestones
from .registry import query
from .retrieving import SIZE
from .scalars import metric_base


@query("register_metrics", """
SELECT program, (CAST(sum(CAST(total * discount * 10000 AS BIGINT)) AS DOUBLE) / 100)
    / CAST(sum(CAST(total * 100 AS BIGINT)) AS DOUBLE) AS discount_rate,
  CAST(sum(CAST(total * 100 AS BIGINT)) AS DOUBLE) / CAST(sum(quantity) AS DOUBLE) AS unit_cost
FROM x_lu GROUP BY program""")
def _(t):
    U.register_metrics(t.spark, R.TABLES["metric"][1])
    return metric_base(t).selectExpr(
        "program", "discount_rate(discount_cents, gross_cents) AS discount_rate",
        "unit_cost(gross_cents, quantity) AS unit_cost")


def _sums(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums for a straight-line fit; accepts raw rows (x, y) or earlier sums."""
    if "sxx" not in rows:
        rows = pd.DataFrame({"kind": rows["kind"], "n": 1, "sx": rows["x"], "sy": rows["y"],
                             "sxx": rows["x"] ** 2, "sxy": rows["x"] * rows["y"]})
    return rows.groupby("kind", as_index=False)[["n", "sx", "sy", "sxx", "sxy"]].sum()


def _slope(sums: pd.DataFrame) -> pd.DataFrame:
    s = sums[["n", "sx", "sy", "sxx", "sxy"]].sum()
    slope = (s.n * s.sxy - s.sx * s.sy) / (s.n * s.sxx - s.sx ** 2)
    return pd.DataFrame({"kind": [sums["kind"].iloc[0]], "n": [int(s.n)], "slope": [round(slope, 6)]})


query("grouped_analysis", """
SELECT kind, count(*) AS n, round(regr_slope(CAST(value AS DOUBLE), CAST(k AS DOUBLE)), 6) AS slope
FROM x_ev GROUP BY kind""")(
    lambda t: U.grouped_analysis(
        t.event.select("kind", F.col("k").cast("double").alias("x"),
                       F.col("value").cast("double").alias("y")), ["kind"], _sums,
        "kind string, n long, sx double, sy double, sxx double, sxy double", _slope,
        "kind string, n long, slope double"))

query("weighted_progress", """
SELECT program, CAST(coalesce(sum(weight) FILTER (done), 0) AS DOUBLE) / sum(weight) AS progress
FROM x_mile GROUP BY 1""")(
    lambda t: milestones(t).groupBy("program").agg(
        weighted_progress(F.col("done").cast("long"), "weight").alias("progress")))


@query("passages_udtf", """
SELECT doc_id, CAST(no AS INT) AS passage_no, CAST(sec AS INT) AS section, CAST(s AS INT) AS start,
  CAST(e AS INT) AS fin, md5(text) AS text_hash FROM x_passage""")
def _(t):
    t.spark.udtf.register("passages", U.Passages)
    t.document.select("doc_id", "text").createOrReplaceTempView("passage_input")
    return t.spark.sql(f"""SELECT doc_id, passage_no, section, start, fin, md5(passage) AS text_hash
        FROM passage_input, LATERAL passages(text, {SIZE})""")
