"""Inputs of the registered queries that have no table of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..scale import windowed


def schedule(t):
    """Dated amounts: own tasks, open procurement, payments made."""
    lu = t.line_unit
    open_lines = lu.filter("line_status = 'O'").select(
        "program", "activity_id",
        F.when(F.col("execution_mode") == "DIRECT", "TASK").otherwise("PROCUREMENT")
        .alias("origin"), F.col("work_date").alias("period"),
        F.col("total").alias("planned_amount"))
    paid = t.payment.join(t.activity_unit.select("activity_id", "program"), "activity_id").select(
        "program", "activity_id", F.lit("PAYMENT").alias("origin"),
        F.col("pay_date").alias("period"), F.col("amount").alias("planned_amount"))
    return open_lines.unionByName(paid)


def staged_facts(t):
    owner = t.activity_unit.select("activity_id", "program", "start_date", "allocation")
    def month(c):
        return F.date_format(c, "yyyy-MM").alias("month")
    granted = owner.select("program", month("start_date"), F.lit("allocation").alias("stage"),
                           F.col("allocation").alias("amount"))
    who = owner.select("activity_id", "program")
    signed = t.contract.join(who, "activity_id").select(
        "program", month("signature_date"), F.lit("commitment").alias("stage"),
        F.col("award_amount").alias("amount"))
    pay = t.payment.join(who, "activity_id")
    due = pay.select("program", month("pay_date"), F.lit("liquidation").alias("stage"), "amount")
    paid = pay.filter(~F.col("rejected")).select(
        "program", month("pay_date"), F.lit("payment").alias("stage"), "amount")
    return granted.unionByName(signed).unionByName(due).unionByName(paid)


def price_points(t):
    """Price observations: estimates (open lines), contract and market prices."""
    return t.line.select(
        "resource_id", F.when(F.col("line_status") == "O", "ESTIMATE")
        .when(F.col("return_flag") == "R", "CONTRACT").otherwise("MARKET").alias("source"),
        F.col("unit_cents").alias("cents"), F.col("work_date").alias("observed"))


def offers(t):
    return t.line.join(t.activity.select("activity_id", "start_date"), "activity_id").select(
        "resource_id", "supplier_id", "unit_cents", "activity_id", "seq",
        F.date_diff("work_date", "start_date").alias("delay"),
        (F.col("return_flag") == "R").alias("failed"))


def projects(t):
    """One investment project per unit."""
    cost = t.activity.groupBy("budget_activity_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("allocation").cast("decimal(18,2)").alias("cost"))
    u = t.unit
    return u.join(cost, u.unit_id == cost.budget_activity_id, "left").select(
        F.col("unit_id").alias("project_id"), "institution_id", "institution", "program", "score",
        (F.col("unit_id") % 10 == 0).alias("mandatory"),
        F.coalesce("n", F.lit(0)).alias("n_orders"),
        F.coalesce("cost", F.lit(0).cast("decimal(18,2)")).alias("total_cost"),
        F.least(F.coalesce("n", F.lit(0)), F.lit(8)).cast("int").alias("stage"))


def milestones(t):
    lu = t.line_unit
    return lu.select("activity_id", "seq", F.date_add("start_date", F.col("seq") * 30)
                     .alias("planned_date"), F.col("work_date").alias("actual_date"),
                     F.col("quantity").alias("weight"), (F.col("line_status") == "F").alias("done"),
                     (F.col("return_flag") == "N").alias("evidenced"), "return_flag", "program",
                     "execution_mode", "total")


def indicator_days(t):
    """Daily observation per indicator."""
    return t.event.groupBy(F.col("kind").alias("indicator"), "day").agg(
        F.sum("value").cast("decimal(18,2)").alias("total"), F.count(F.lit(1)).alias("n"))


def indicator_results(t):
    """Weekly actual against the target of that week of the month. Weeks are numbered through, five
    to a month from 2020 on, so those of different months stay apart."""
    slot = (F.floor((F.dayofmonth("day") - 1) / 7) + 1).cast("int")
    week = ((F.year("day") - 2020) * 60 + (F.month("day") - 1) * 5 + slot).cast("int")
    weekly = t.event.groupBy(F.col("kind").alias("indicator"), week.alias("week"), slot.alias("slot")).agg(
        (F.sum("value").cast("double") / F.count(F.lit(1))).alias("actual"),
        F.count(F.lit(1)).alias("n"))
    targets = t.rule("indicator_target").withColumnRenamed("week", "slot")
    return weekly.join(t.rule("indicator").select("indicator", "direction", "program"),
                       "indicator").join(targets, ["indicator", "slot"]).drop("slot")


def recommendations(t):
    """An incident opens a recommendation; the actor's next purchase closes it."""
    ev = t.event.withColumn("_buy", F.when(F.col("kind") == "purchase", F.col("ts")))
    # next purchase = smallest later one: scan backwards with a running maximum of the negated time
    back = -F.unix_micros(F.col("ts").cast("timestamp"))
    marked = ev.withColumn("_neg", F.when(
        F.col("kind") == "purchase", -F.unix_micros(F.col("ts").cast("timestamp"))))
    found = windowed(marked, ["actor"], [back, -F.col("event_id")], _next=("max_before", "_neg"))
    return found.filter("kind = 'error'").select(
        "event_id", F.concat(F.lit("S"), (F.col("k") % 4).cast("string")).alias("source"),
        F.col("actor").alias("owner"), F.col("day").alias("opened_on"),
        F.date_add("day", 7).alias("deadline"),
        F.to_date(F.timestamp_micros(-F.col("_next"))).alias("closed_on"))


def risks(t):
    return t.event.select("event_id", (1 + F.col("actor") % 5).cast("int").alias("probability"),
                          (1 + F.col("k") % 5).alias("impact"), F.col("actor").alias("owner"),
                          F.col("day").alias("opened_on"))


def chain(t):
    """Every cost line with the links from priority to result that it has."""
    yes = F.lit(True)
    return t.line_unit.select(
        "program", F.col("total").alias("spending"),
        (F.col("activity_id") % 4 != 0).alias("has_objective"), yes.alias("has_activity"),
        yes.alias("has_cost"), F.col("supplier_id").isNotNull().alias("has_contract"),
        ((F.col("line_status") == "F") & (F.col("return_flag") != "R")).alias("has_payment"),
        ((F.col("return_flag") == "N") | (F.col("line_status") == "F")).alias("has_result"))


def ai_runs(t):
    """Agent runs: outcome by event kind, cost by value."""
    kind = F.col("kind")
    return t.event.select(
        "event_id", "ts", "actor", (F.col("actor") % 25).cast("int").alias("organisation"),
        kind.alias("agent"), (F.col("k") % 3).alias("model"), (F.col("k") % 5).alias("tool"), "k",
        F.when(kind == "purchase", "ACCEPT").when(kind == "click", "EDIT")
        .when(kind == "error", "REJECT").alias("outcome"), F.col("value").alias("cost"))


def expert_cases(t, limit: int = 500):
    """Predicted quality (by length) and the experts' judgement."""
    predicted = t.document.select("doc_id", "lang",
                                  (F.col("n_chars") >= limit).cast("int").alias("predicted"))
    return predicted, t.raw("labels").select("doc_id", F.col("quality").alias("expected"))
