"""Derivation and what-if jobs: whole tables in, whole tables out, base data never changed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import windowed
from ..session import cut
from .graph import hierarchy_closure

MONEY = "decimal(18,2)"


def reverse_schedule(needs: DataFrame, durations: dict[str, int], needed: str) -> DataFrame:
    """Latest safe date of every stage, counting back from the needed-by date."""
    days = F.map_from_arrays(F.array(*[F.lit(k) for k in durations]),
                             F.array(*[F.lit(v) for v in durations.values()]))
    back, out = 0, needs
    for stage in reversed(list(durations)):
        back += durations[stage]
        out = out.withColumn(f"{stage}_by", F.date_sub(F.col(needed), back))
    total = F.aggregate(F.map_values(days), F.lit(0), lambda a, d: a + d)
    return out.withColumn("total_days", total)


def spread_schedule(facts: DataFrame, start: str, months: str, amount: str,
                    weights: str | None = None) -> DataFrame:
    """Spread an amount over months, evenly or by a weight array; the last month takes the
    remainder, so no cent is lost."""
    cents = F.round(F.col(amount) * 100).cast("long")
    n = F.col(months).cast("int")
    base = facts.withColumn("_cents", cents).withColumn(
        "_parts", F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
            i.alias("i"), F.lit(1.0).alias("_w") if weights is None
            else F.element_at(F.col(weights), i + 1).cast("double").alias("_w"))))
    if weights is None:
        share = F.floor(F.col("_cents") / n)
    else:
        total = F.aggregate(F.slice(F.col(weights), 1, n), F.lit(0.0),
                            lambda a, w: a + w.cast("double"))
        share = F.floor(F.col("_cents") * F.col("_p._w") / total)
    rows = base.withColumn("_p", F.explode("_parts"))
    each = rows.withColumn("_share", share.cast("long"))
    if weights is None:
        before = F.col("_share") * (n - 1)
    else:
        before = F.aggregate(F.slice(F.col("_parts"), 1, n - 1), F.lit(0).cast("long"),
                             lambda a, p: a + F.floor(F.col("_cents") * p["_w"] / total))
    last = F.col("_p.i") == n - 1
    value = F.when(last, F.col("_cents") - before).otherwise(F.col("_share"))
    first = F.to_date(F.date_trunc("month", F.col(start)))
    return each.select(*facts.columns, F.add_months(first, F.col("_p.i")).alias("period"),
                       (value.cast("decimal(20,0)") * F.lit("0.01").cast("decimal(3,2)"))
                       .cast(MONEY).alias("planned_amount"))


def derive_needs(activities: DataFrame, lines: DataFrame, resources: DataFrame,
                 categories: DataFrame) -> DataFrame:
    """Task → resource → external requirement → need, keeping the links to its origin."""
    external = activities.filter(F.col("execution_mode") != "DIRECT")
    return (lines.join(external, "activity_id").join(resources, "resource_id")
            .join(categories, "resource_type").select(
        F.concat_ws("-", "activity_id", "seq", "resource_id", "supplier_id").alias("need_id"),
        "fiscal_year", F.col("activity_id").alias("source_activity"),
        F.col("seq").alias("source_task"), "resource_id", F.col("label").alias("description"),
        "category", "quantity", F.col("total").alias("estimated_amount"),
        F.col("work_date").alias("needed_by_date"), F.lit("DRAFT").alias("status")))


def derive_pcc(tasks: DataFrame, procurement: DataFrame, contracts: DataFrame, keys: list[str]
               ) -> DataFrame:
    """Consumption schedule from the three calendars. Each part has keys, start, months, amount;
    amounts are combined per start and length first, so few rows are spread."""
    def packed(df, origin):
        return df.groupBy(*keys, "start", "months", F.lit(origin).alias("origin")).agg(
            F.sum("amount").cast(MONEY).alias("amount"))
    union = reduce(DataFrame.unionByName, [
        packed(tasks, "TASK"), packed(procurement, "PROCUREMENT"), packed(contracts, "CONTRACT")])
    return (spread_schedule(union, "start", "months", "amount")
            .groupBy(*keys, "origin", "period")
            .agg(F.sum("planned_amount").cast(MONEY).alias("amount")))


def generate_ppm(needs: DataFrame, rules: DataFrame, durations: dict[str, int],
                 keys: list[str]) -> DataFrame:
    """Draft procurement plan: group needs, total them, look up the procedure, count back dates."""
    from .joins import procedure_for_need
    grouped = needs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_needs"), F.sum("total").cast(MONEY).alias("estimated_amount"),
        F.min("work_date").alias("needed_by_date"))
    ruled = procedure_for_need(grouped, rules, "estimated_amount", "needed_by_date")
    dated = reverse_schedule(ruled, durations, "needed_by_date")
    return dated.withColumn("status", F.lit("AI_DRAFT"))


def baseline_plan(recurrent: DataFrame, commitments: DataFrame, ongoing: DataFrame,
                  recommendations: DataFrame, year: int) -> DataFrame:
    """Plan of the next year: commitments first, then ongoing, recurrent and recommended items.

    An item that comes from several origins keeps the strongest. Parts carry item and amount."""
    order = {"COMMITMENT": 1, "ONGOING": 2, "RECURRENT": 3, "RECOMMENDATION": 4}
    parts = {"COMMITMENT": commitments, "ONGOING": ongoing, "RECURRENT": recurrent,
             "RECOMMENDATION": recommendations}
    tagged = [df.select("item", F.col("amount").cast(MONEY).alias("amount"),
                        F.lit(order[o]).alias("rank"), F.lit(o).alias("origin"))
              for o, df in parts.items()]
    every = reduce(DataFrame.unionByName, tagged)
    return every.groupBy("item").agg(
        F.min_by(F.struct("origin", "rank"), "rank").alias("_o"),
        F.max("amount").alias("amount")).select(
        "item", F.lit(year).alias("fiscal_year"), "_o.origin", "_o.rank", "amount")


def new_year_rollover(reference: DataFrame, year: int, ceilings: list[str]) -> DataFrame:
    """References and ceilings copied to a new fiscal year; consumption starts at zero."""
    latest = reference.filter(F.col("fiscal_year") == year - 1)
    fresh = latest.withColumn("fiscal_year", F.lit(year))
    for c in reference.columns:
        if c not in ("fiscal_year", *ceilings) and "decimal" in reference.schema[c].dataType.simpleString():
            fresh = fresh.withColumn(c, F.lit(0).cast(reference.schema[c].dataType))
    return reference.unionByName(fresh)


def scenario_overlay(base: DataFrame, delta: DataFrame, scenario: str, keys: list[str],
                     values: list[str]) -> DataFrame:
    """Base rows overlaid by the scenario's rows; a deleted row has ``removed`` true."""
    b = base.select(*keys, F.struct(*values).alias("_b"))
    d = delta.select(*keys, F.struct(*values, "removed").alias("_d"))
    j = b.join(d, keys, "full_outer").filter(~F.coalesce("_d.removed", F.lit(False)))
    return j.select(*keys, *[F.coalesce(f"_d.{v}", f"_b.{v}").alias(v) for v in values],
                    F.lit(scenario).alias("scenario"), F.col("_d").isNotNull().alias("overlaid"))


def scenario_reduce(base: DataFrame, amount: str, percent: int, priority: Column | None = None
                    ) -> DataFrame:
    """Proportional reduction in percent, or with ``priority`` only the priority rows, in full."""
    if priority is not None:
        return base.filter(priority).withColumn("scenario_amount", F.col(amount))
    factor = F.lit(100 - percent).cast("decimal(3,0)") * F.lit("0.01").cast("decimal(3,2)")
    return base.withColumn("scenario_amount", F.round(F.col(amount) * factor, 2).cast(MONEY))


def reallocate(envelopes: DataFrame, moves: DataFrame, key: str) -> DataFrame:
    """Effect of moving amounts between envelopes: (from, to, amount) rows against balances."""
    out = moves.select(F.col("from_key").alias(key), (-F.col("amount")).alias("_a"))
    into = moves.select(F.col("to_key").alias(key), F.col("amount").alias("_a"))
    change = out.unionByName(into).groupBy(key).agg(F.sum("_a").cast(MONEY).alias("change"))
    return (envelopes.join(change, key, "left")
            .withColumn("change", F.coalesce("change", F.lit(0).cast(MONEY)))
            .withColumn("available_after", F.col("available") + F.col("change"))
            .withColumn("overdrawn", F.col("available_after") < 0))


def shift_schedule(schedule: DataFrame, shifts: DataFrame, ident: str, keys: list[str]
                   ) -> DataFrame:
    """Profile before and after moving objects by months: shifts has (ident, months)."""
    moved = schedule.join(shifts, ident, "left").select(
        *keys, F.col("period"), F.add_months("period", F.coalesce("months", F.lit(0))).alias("_new"),
        "planned_amount")
    both = moved.select(*keys, F.explode(F.array(
        F.struct(F.date_format("period", "yyyy-MM").alias("month"),
                 F.col("planned_amount").alias("before"), F.lit(0).cast(MONEY).alias("after")),
        F.struct(F.date_format("_new", "yyyy-MM").alias("month"),
                 F.lit(0).cast(MONEY).alias("before"), F.col("planned_amount").alias("after"))))
        .alias("x")).select(*keys, "x.*")
    return both.groupBy(*keys, "month").agg(F.sum("before").cast(MONEY).alias("before"),
                                            F.sum("after").cast(MONEY).alias("after"))


def propagate_revision(amounts: DataFrame, edges: DataFrame, revisions: DataFrame) -> DataFrame:
    """Pass envelope changes down to everything below: (node, n_revisions, before, after).

    ``amounts`` has node and amount of the lowest envelopes, ``edges`` child and parent of the hierarchy,
    ``revisions`` node and change, at any level; several of one node add up. A change reaches the lowest
    envelopes below (or at) its node pro rata to their amounts, in whole cents: the rounded running
    share less that of the one before, in order of ids, so the parts add up to the change. Negative
    amounts take no part; if none is positive, all take equal parts. Nodes above the lowest envelopes
    have the sums of what is below them; ``n_revisions`` counts the revised nodes at or above a node.
    Nodes no change touches are left out. A revised node may have any number of envelopes below it.
    """
    lowest = amounts.groupBy("node").agg(F.sum("amount").cast(MONEY).alias("amount"))
    change = revisions.groupBy(F.col("node").alias("revised")).agg(F.sum("change").cast(MONEY).alias("change"))
    closure = hierarchy_closure(edges, "child", "parent").select("descendant", "ancestor").distinct()
    nodes = edges.select(F.explode(F.array("child", "parent")).alias("descendant")).unionByName(
        lowest.select(F.col("node").alias("descendant"))).filter("descendant is not null").distinct()
    within = cut(closure.unionByName(nodes.select("descendant", F.col("descendant").alias("ancestor"))))
    hit = within.join(change, F.col("ancestor") == F.col("revised"))
    parts = hit.select(F.col("descendant").alias("node"), "revised", "change").join(lowest, "node")
    weight = F.greatest(F.lit(0).cast("long"), (F.col("amount") * 100).cast("long"))
    weighed = windowed(parts.withColumn("_w", weight), ["revised"], [F.col("node")],
                       _all=("total", "_w"), _upto=("sum", "_w"), _n=("size",), _i=("row_number",))
    none = F.col("_all") == 0
    whole = F.when(none, F.col("_n")).otherwise(F.col("_all")).cast("decimal(19,0)")
    cents = F.abs(F.col("change") * 100).cast("decimal(18,0)")

    def upto(place: Column) -> Column:
        # rounded to the nearest cent, halves up
        return _int_div(2 * cents * place.cast("decimal(19,0)") + whole, 2 * whole)

    here = F.when(none, F.col("_i")).otherwise(F.col("_upto"))
    before = F.when(none, F.col("_i") - 1).otherwise(F.col("_upto") - F.col("_w"))
    share = F.sign(F.col("change")).cast("long") * (upto(here) - upto(before))
    shares = weighed.select("node", (share.cast("decimal(18,0)") / 100).cast(MONEY).alias("share")).groupBy(
        "node").agg(F.sum("share").cast(MONEY).alias("share"))
    levels = lowest.join(shares, "node", "left").select(
        F.col("node").alias("descendant"), "amount", F.coalesce("share", F.lit(0).cast(MONEY)).alias("share"),
        F.col("share").isNotNull().alias("_hit"))
    sums = levels.join(within, "descendant").groupBy(F.col("ancestor").alias("node")).agg(
        F.sum("amount").cast(MONEY).alias("before"),
        F.sum(F.col("amount") + F.col("share")).cast(MONEY).alias("after"), F.max("_hit").alias("_hit"))
    counted = hit.groupBy(F.col("descendant").alias("node")).agg(F.count(F.lit(1)).alias("_k"))
    return sums.filter("_hit").join(counted, "node", "left").select(
        "node", F.coalesce("_k", F.lit(0)).alias("n_revisions"), "before", "after")


def _int_div(a: Column, b: Column) -> Column:
    """Whole part of the quotient of two decimals without digits after the point."""
    return F.call_function("div", a, b)


def contract_amendments(amendments: DataFrame, contracts: DataFrame, key: str,
                        order: list[Column]) -> DataFrame:
    """State of each contract after each amendment, in order."""
    run = windowed(amendments, [key], order, amendment_no=("row_number",),
                   _a=("sum", "amount_change"), _d=("sum", "duration_change"))
    return run.join(contracts.select(key, "award_amount", "end_date"), key).select(
        key, "amendment_no", "amount_change",
        (F.col("award_amount") + F.col("_a")).alias("amount_after"),
        F.date_add("end_date", F.col("_d").cast("int")).alias("end_after"))


def contract_execution(contracts: DataFrame, milestones: DataFrame, today: str, key: str,
                       guarantee_days: int = 365) -> DataFrame:
    """Milestones met, guarantees expiring soon and receptions pending or returned per contract."""
    day = F.lit(today).cast("date")
    per = milestones.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_milestones"), F.count_if("done").alias("n_accepted"),
        F.count_if(F.col("reception") == "RETURNED").alias("n_returned"),
        F.count_if(F.col("reception") == "PENDING").alias("n_pending"))
    expiry = F.date_add("end_date", guarantee_days)
    return contracts.join(per, key, "left").select(
        key, "n_milestones", "n_accepted", "n_returned", "n_pending",
        expiry.alias("guarantee_until"),
        (expiry.between(day, F.date_add(day, 60))).alias("guarantee_expiring"))


def failed_procurement(attempts: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Failed attempts, whether and when they were relaunched, and the change in amount."""
    nxt = windowed(attempts, [key], order, _date=("lead", "attempt_date"), _amount=("lead", "amount"))
    return nxt.filter("failed").select(
        key, "attempt_no", "cause", F.col("_date").isNotNull().alias("relaunched"),
        F.date_diff("_date", "attempt_date").alias("delay_days"),
        (F.col("_amount") - F.col("amount")).alias("amount_effect"))


def compare_lots(needs: DataFrame, lottings: dict[str, list[str]]) -> DataFrame:
    """Lots, largest lot and competition of several lotting scenarios, side by side.

    Needs are combined at the finest grain once; each scenario regroups those few rows."""
    finest = list(dict.fromkeys(c for cols in lottings.values() for c in cols))
    base = needs.groupBy(*finest, "supplier_id").agg(F.sum("total").alias("_t"))
    parts = []
    for name, cols in lottings.items():
        lot = base.groupBy(*cols, "supplier_id").agg(F.sum("_t").alias("_t")).groupBy(*cols).agg(
            F.sum("_t").alias("_t"), F.count(F.lit(1)).alias("_b"))
        parts.append(lot.agg(
            F.lit(name).alias("scenario"), F.count(F.lit(1)).alias("n_lots"),
            F.max("_t").cast(MONEY).alias("largest_lot"), F.sum("_t").cast(MONEY).alias("amount"),
            (F.sum("_b").cast("double") / F.count(F.lit(1))).alias("mean_bidders")))
    return reduce(DataFrame.unionByName, parts)


def project_packages(needs: DataFrame, project: str, package: str) -> DataFrame:
    """Packages of each project with contract counts; one row per package, names as an array."""
    per = needs.groupBy(project, package, "activity_id", "supplier_id").agg(
        F.sum("total").alias("_t")).groupBy(project, package).agg(
        F.count(F.lit(1)).alias("n_contracts"), F.sum("_t").alias("_t"))
    # packages are category names, so the array has at most a handful of entries
    return per.groupBy(project).agg(
        F.array_sort(F.collect_list(F.col(package))).alias("packages"),
        F.sum("n_contracts").alias("n_contracts"), F.sum("_t").cast(MONEY).alias("amount"))


def cost_learning(observations: DataFrame, paid: DataFrame) -> DataFrame:
    """Paid unit costs per resource and year written back as reference observations."""
    learned = paid.groupBy("resource_id", "year").agg(
        F.sum("cents").alias("_c"), F.sum("quantity").alias("_q")).select(
        "resource_id", "year", F.lit("PAID").alias("source"),
        F.round(F.col("_c") / F.col("_q")).cast("long").alias("cents"))
    return observations.unionByName(learned)
