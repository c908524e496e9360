"""The flagship question: which programs need more than their ceiling, by how much, per month?"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import money
from ..operators.aggregates import over_ceiling, pcc_monthly
from ..sources.bindings import Tables


def ceiling_pressure(spark, path):
    t = Tables(spark, path)
    pressed = over_ceiling(t.envelope).select("program", "fiscal_year", "need", "available",
                                              "shortfall")
    lines = t.line_unit.filter("status = 'IN_PREPARATION'").select(
        "program", "fiscal_year", F.col("work_date").alias("period"),
        F.col("total").alias("planned_amount"))
    monthly = pcc_monthly(lines, ["program", "fiscal_year"])
    return monthly.join(pressed, ["program", "fiscal_year"]).select(
        "program", "fiscal_year", "month", money("amount").alias("month_need"),
        money("need").alias("need"), money("available").alias("available"),
        money("shortfall").alias("shortfall"))
