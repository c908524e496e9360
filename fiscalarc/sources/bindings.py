"""The canonical tables of the data model as projections of the landed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scale import small
from .rules import rule
from .schemas import landed

MONEY = "decimal(18,2)"


class Tables:
    """Lazy canonical tables over one folder of landed Parquet files."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(landed(name)).parquet(f"{self.path}/{name}.parquet")

    def rule(self, name: str) -> DataFrame:
        return F.broadcast(rule(self.spark, name))

    @property
    def activity(self) -> DataFrame:
        """Operational activities; the budget activity is the unit that owns them."""
        return self.raw("orders").select(
            F.col("o_orderkey").alias("activity_id"),
            F.col("o_custkey").alias("budget_activity_id"),
            F.year("o_orderdate").alias("fiscal_year"),
            F.to_date("o_orderdate").alias("start_date"),
            F.when(F.col("o_orderkey") % 3 == 0, "DIRECT")
            .when(F.col("o_orderkey") % 3 == 1, "INDIRECT").otherwise("MIXED")
            .alias("execution_mode"),
            F.when(F.col("o_orderstatus") == "F", "CLOSED")
            .when(F.col("o_orderstatus") == "O", "IN_EXECUTION").otherwise("IN_PREPARATION")
            .alias("status"),
            F.col("o_orderpriority").alias("priority"),
            F.col("o_totalprice").cast(MONEY).alias("allocation"),
        )

    @property
    def line(self) -> DataFrame:
        """Costing lines: a task of an activity and the resource it uses."""
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("activity_id"),
            F.col("l_linenumber").alias("seq"),
            F.col("l_partkey").alias("resource_id"),
            F.col("l_suppkey").alias("supplier_id"),
            F.col("l_quantity").cast("long").alias("quantity"),
            F.col("l_extendedprice").cast(MONEY).alias("total"),
            F.expr("(2 * {c} + {q}) div (2 * {q})".format(
                c="cast(round(l_extendedprice * 100) as bigint)",
                q="cast(l_quantity as bigint)")).alias("unit_cents"),
            F.col("l_discount").cast("decimal(4,2)").alias("discount"),
            F.col("l_tax").cast("decimal(4,2)").alias("tax"),
            F.col("l_returnflag").alias("return_flag"),
            F.col("l_linestatus").alias("line_status"),
            F.to_date("l_shipdate").alias("work_date"),
        )

    @property
    def price(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("resource_id"), F.col("p_name").alias("label"),
            F.col("p_brand").alias("brand"), F.col("p_type").alias("resource_type"),
            F.col("p_size").alias("size"), F.col("p_retailprice").cast(MONEY).alias("ref_price"),
            F.round(F.col("p_retailprice") * 100).cast("long").alias("ref_cents"))

    @property
    def ministry(self) -> DataFrame:
        nation, region = self.raw("nation"), self.raw("region")
        return nation.join(small(region), nation.n_regionkey == region.r_regionkey).select(
            F.col("n_nationkey").alias("ministry_id"), F.col("n_name").alias("ministry"),
            F.col("r_regionkey").alias("institution_id"), F.col("r_name").alias("institution"))

    @property
    def unit(self) -> DataFrame:
        """Budget activities (units) with program, ministry and institution."""
        customer = self.raw("customer").select(
            F.col("c_custkey").alias("unit_id"), F.col("c_name").alias("unit_name"),
            F.col("c_mktsegment").alias("program"), F.col("c_nationkey").alias("ministry_id"),
            F.col("c_acctbal").cast(MONEY).alias("score"))
        return customer.join(small(self.ministry), "ministry_id")

    @property
    def supplier(self) -> DataFrame:
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("supplier"),
            F.col("s_nationkey").alias("ministry_id"))

    @property
    def contract(self) -> DataFrame:
        return self.line.groupBy("activity_id", "supplier_id").agg(
            F.sum("total").cast(MONEY).alias("award_amount"),
            F.min("work_date").alias("signature_date"),
            F.max("work_date").alias("end_date"),
            F.count(F.lit(1)).alias("n_lines"),
        ).withColumn("contract_number", F.concat_ws(":", "activity_id", "supplier_id"))

    @property
    def payment(self) -> DataFrame:
        return self.line.filter(F.col("line_status") == "F").select(
            "activity_id", "supplier_id", "resource_id", "seq", F.col("work_date").alias("pay_date"),
            F.round(F.col("total") * (1 - F.col("discount")), 2).cast(MONEY).alias("amount"),
            (F.col("return_flag") == "R").alias("rejected"))

    @property
    def event(self) -> DataFrame:
        return self.raw("events").select(
            "event_id", "ts", F.to_date("ts").alias("day"), F.col("user_id").alias("actor"),
            F.col("event_type").alias("kind"), F.col("value").cast(MONEY).alias("value"),
            F.get_json_object("props", "$.k").cast("int").alias("k"), "props")

    @property
    def document(self) -> DataFrame:
        return self.raw("documents")

    @property
    def activity_unit(self) -> DataFrame:
        act, unit = self.activity, self.unit
        return act.join(unit, act.budget_activity_id == unit.unit_id).drop("unit_id")

    @property
    def line_activity(self) -> DataFrame:
        return self.line.join(self.activity, "activity_id")

    @property
    def line_unit(self) -> DataFrame:
        return self.line.join(self.activity_unit, "activity_id")

    @property
    def need(self) -> DataFrame:
        """Procurement needs: lines of activities not executed internally."""
        lines = self.line.join(
            self.activity_unit.filter(F.col("execution_mode") != "DIRECT"), "activity_id")
        return (lines.join(self.price.select("resource_id", "resource_type", "label"),
                           "resource_id")
                .join(self.rule("category_map"), "resource_type")
                .join(self.rule("funding_map"), "priority")
                .join(self.rule("authority_map"), "institution_id"))

    @property
    def envelope(self) -> DataFrame:
        from ..operators.aggregates import envelope_balance
        return envelope_balance(self.activity_unit, self.line, self.rule("program_factor"))
