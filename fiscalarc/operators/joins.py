"""Joins. Fact-to-fact joins are pre-aggregated and left to AQE; only rule tables broadcast."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import holds_at
from ..scale import small, windowed
from .temporal import as_of

MONEY = "decimal(18,2)"


def _zero() -> Column:
    return F.lit(0).cast(MONEY)


def canonical_chain(activities: DataFrame, lines: DataFrame, contracts: DataFrame,
                    payments: DataFrame) -> DataFrame:
    """Program → activity → tasks and cost → contract → payment, one row per contract."""
    cost = lines.groupBy("activity_id", "supplier_id").agg(
        F.count(F.lit(1)).alias("n_tasks"), F.sum("total").cast(MONEY).alias("cost"))
    paid = payments.filter(~F.col("rejected")).groupBy("activity_id", "supplier_id").agg(
        F.sum("amount").cast(MONEY).alias("paid"))
    on = ["activity_id", "supplier_id"]
    per_contract = cost.join(contracts, on, "left").join(paid, on, "left")
    return activities.join(per_contract, "activity_id", "left")


def classify_lines(lines: DataFrame, units: DataFrame, resources: DataFrame) -> DataFrame:
    """Attach the six classifications, kept as six separate columns."""
    return (lines.join(small(units), "budget_activity_id")
            .join(small(resources), "resource_id"))


def price_as_of(lines: DataFrame, prices: DataFrame) -> DataFrame:
    """Latest price of the resource dated strictly before the line; lowest price on equal dates."""
    one = prices.groupBy("resource_id", "observed").agg(F.min("cents").alias("reference_cents"))
    return as_of(lines, one, ["resource_id"], "work_date", "observed", ["reference_cents"],
                 strict=True)


def price_overrides(candidates: DataFrame, precedence: DataFrame, key: str) -> DataFrame:
    """Per resource the price of the most authoritative source; the newest, then lowest, on ties."""
    ranked = candidates.join(precedence, "source")
    order = F.struct("precedence", F.date_diff(F.lit("2100-01-01").cast("date"), "observed"),
                     "cents")
    return ranked.groupBy(key).agg(
        F.min_by(F.struct("source", "cents"), order).alias("_p")).select(key, "_p.*")


def procedure_for_need(needs: DataFrame, rules: DataFrame, amount: str, dated: str) -> DataFrame:
    """Procedure, control authority and legal source by category, authority, regime, band, date."""
    on = ["category", "authority_type", "regime"]
    r = rules.select(*on, "procedure", "control_authority", "legal_source", "lower_bound",
                     "upper_bound", "valid_from", "valid_to")
    j = needs.join(small(r), on)
    inside = (F.col(amount) >= F.col("lower_bound")) & (
        F.col("upper_bound").isNull() | (F.col(amount) < F.col("upper_bound")))
    return j.filter(inside & holds_at(F.col(dated))).drop(
        "lower_bound", "upper_bound", "valid_from", "valid_to")


def role_holder_at(events: DataFrame, assignments: DataFrame, role: str, dated: str) -> DataFrame:
    """Who held the role on the day of each event; null when the latest assignment has ended."""
    found = as_of(events, assignments, [role], dated, "valid_from", ["person_id", "valid_to"])
    ended = F.col("valid_to").isNotNull() & (F.col("valid_to") <= F.col(dated))
    return found.withColumn("person_id", F.when(~ended, F.col("person_id"))).drop("valid_to")


def sod_violations(transitions: DataFrame, obj: str, person: str, step: str) -> DataFrame:
    """Persons who took more than one of prepare, check and approve on the same object.

    The steps become flags of one aggregation, so no pairs of log rows are built.
    """
    flags = [F.max((F.col(step) == s).cast("int")).alias(s.lower())
             for s in ("PREPARE", "CHECK", "APPROVE")]
    return (transitions.groupBy(obj, person).agg(*flags)
            .filter(F.col("prepare") + F.col("check") + F.col("approve") >= 2))


def assignment_overlaps(assignments: DataFrame, role: str, ident: str) -> DataFrame:
    """Assignments that begin before an earlier assignment of the role has ended."""
    seen = windowed(assignments, [role], [F.col("valid_from"), F.col(ident)],
                    busy_until=("max_before", "valid_to"))
    return seen.filter(F.col("busy_until") > F.col("valid_from"))


def gap_detection(objectives: DataFrame, activities: DataFrame, links: DataFrame,
                  programs: DataFrame, indicators: DataFrame, priorities: DataFrame,
                  funded: DataFrame) -> DataFrame:
    """Objectives without programming, unaligned activities, programs without indicator and
    priorities without funding. Inputs carry one ``id`` column each; links carry ``id`` too."""
    def missing(left, right, kind):
        return left.join(right.select("id").distinct(), "id", "left_anti").select(
            F.lit(kind).alias("gap"), F.col("id").cast("string").alias("id"))
    parts = [missing(objectives, activities.select(F.col("objective").alias("id")),
                     "objective_without_programming"),
             missing(activities.select("id"), links, "activity_not_aligned"),
             missing(programs, indicators, "program_without_indicator"),
             missing(priorities, funded, "priority_without_funding")]
    return reduce(DataFrame.unionByName, parts)


def compliance_check(contracts: DataFrame, activities: DataFrame, evidence: DataFrame,
                     max_days: int = 365) -> DataFrame:
    """Six controls per contract and whether all hold."""
    e = evidence.groupBy("activity_id", "supplier_id").agg(
        F.bool_or("paid").alias("control_done"), F.bool_or("documented").alias("documents_present"))
    j = contracts.join(activities, "activity_id").join(e, ["activity_id", "supplier_id"], "left")
    out = j.select(
        "contract_number", (F.col("status") != "IN_PREPARATION").alias("plan_approved"),
        ((F.col("execution_mode") != "DIRECT") | (F.col("n_lines") == 1))
        .alias("procedure_coherent"),
        F.coalesce("control_done", F.lit(False)).alias("control_done"),
        F.coalesce("documents_present", F.lit(False)).alias("documents_present"),
        (F.date_diff("end_date", "start_date") <= max_days).alias("deadlines_met"),
        (F.col("award_amount") <= F.col("allocation")).alias("approved"))
    whole = reduce(lambda a, b: a & b, [F.col(c) for c in out.columns if c != "contract_number"])
    return out.withColumn("compliant", whole)


def audit_pack(found: DataFrame, key: str, pieces: list[str]) -> DataFrame:
    """The pieces of each contract file and the missing ones. ``found`` has (key, piece_no 1..n)."""
    have = found.groupBy(key).agg(F.bit_or(F.expr("shiftleft(1, piece_no - 1)")).alias("_b"))
    names = F.array(*[F.lit(p) for p in pieces])

    def listed(bit):
        return F.array_join(F.filter(
            names, lambda p, i: F.getbit(F.col("_b"), i).cast("int") == bit), ",")

    return have.select(key, listed(1).alias("present"), listed(0).alias("missing"),
                       (F.lit(len(pieces)) - F.bit_count("_b")).alias("n_missing"))


def locked_clause_check(docs: DataFrame, clause: str, ident: str, text: str) -> DataFrame:
    """Copies of a locked clause whose text differs from the official (lowest id) version."""
    hashed = docs.select(ident, clause, F.sha2(text, 256).alias("hash"))
    official = hashed.groupBy(clause).agg(
        F.min_by("hash", ident).alias("official_hash"), F.min(ident).alias("official_id"))
    return (hashed.join(small(official), clause)
            .filter((F.col("hash") != F.col("official_hash"))
                    & (F.col(ident) != F.col("official_id")))
            .select(ident, clause, "official_id", "hash"))


def cost_reconcile(plan: DataFrame, contracts: DataFrame, payments: DataFrame, key: str
                   ) -> DataFrame:
    """Planned, contracted and paid amounts side by side, unmatched sides kept."""
    def side(df, amount, name):
        return df.groupBy(key).agg(F.sum(amount).cast(MONEY).alias(name))
    out = (side(plan, "allocation", "planned")
           .join(side(contracts, "award_amount", "contracted"), key, "full_outer")
           .join(side(payments.filter(~F.col("rejected")), "amount", "paid"), key, "full_outer"))
    return out.select(key, *[F.coalesce(c, _zero()).alias(c)
                             for c in ("planned", "contracted", "paid")],
                      F.col("contracted").isNull().alias("no_contract"),
                      F.col("paid").isNull().alias("no_payment"))


def planned_vs_actual(plan: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Dates, quantities and costs side by side with their differences."""
    j = plan.join(actual, key, "full_outer")
    return (j.withColumn("delay_days", F.date_diff("actual_date", "planned_date"))
            .withColumn("quantity_gap", F.coalesce("actual_quantity", F.lit(0))
                        - F.coalesce("planned_quantity", F.lit(0)))
            .withColumn("cost_gap", F.coalesce("actual_cost", _zero())
                        - F.coalesce("planned_cost", _zero())))


def diff(old: DataFrame, new: DataFrame, keys: list[str], labels: dict[str, str]) -> DataFrame:
    """Row-level difference of two versions: added, removed, or the labels of changed columns."""
    def tag(df, name):
        return df.select(*keys, F.struct(*labels.keys()).alias(name))
    j = tag(old, "old").join(tag(new, "new"), keys, "full_outer")
    changed = F.array_compact(F.array(*[
        F.when(~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")), F.lit(label))
        for c, label in labels.items()]))
    change = (F.when(F.col("old").isNull(), F.lit("added"))
              .when(F.col("new").isNull(), F.lit("removed"))
              .otherwise(F.array_join(changed, ",")))
    return j.withColumn("change", change).filter(F.col("change") != "").select(
        *keys, "change", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for c in labels
                           for s in ("old", "new")])


def plan_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return diff(old, new, keys, {"allocation": "amount", "start_date": "period",
                                 "task": "task"})


def ppm_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return diff(old, new, keys, {"estimated_amount": "amount", "launch_date": "calendar",
                                 "procedure": "procedure"})


def physical_financial_matrix(physical: DataFrame, financial: DataFrame, procurement: DataFrame,
                              key: str) -> DataFrame:
    """Counts of objects by physical and financial progress band and procurement status."""
    def band(c):
        return (F.when(F.coalesce(c, F.lit(0.0)) < 1 / 3, "LOW")
                .when(F.coalesce(c, F.lit(0.0)) < 2 / 3, "MEDIUM").otherwise("HIGH"))
    j = (physical.select(key, band(F.col("progress")).alias("physical"))
         .join(financial.select(key, band(F.col("progress")).alias("financial")), key, "left")
         .join(procurement.select(key, "procurement"), key, "left"))
    grid = (j.withColumn("financial", F.coalesce("financial", F.lit("LOW")))
            .groupBy("physical", "procurement").pivot("financial", ["LOW", "MEDIUM", "HIGH"])
            .agg(F.count(F.lit(1))))
    return grid.select("physical", "procurement", *[
        F.coalesce(b, F.lit(0)).alias(f"financial_{b.lower()}") for b in ("LOW", "MEDIUM", "HIGH")])


def config_overlay(scopes: DataFrame, national: DataFrame, institution: DataFrame,
                   program: DataFrame) -> DataFrame:
    """Effective settings per scope: program over institution over national, except locked keys.

    ``scopes`` carries a ``key`` per row (a scope is exploded over the governed keys beforehand).
    """
    n = national.select("key", F.col("value").alias("_n"), "locked")
    i = institution.select("institution_id", "key", F.col("value").alias("_i"))
    p = program.select("program", "key", F.col("value").alias("_p"))
    j = (scopes.join(n, "key").join(i, ["institution_id", "key"], "left")
         .join(p, ["program", "key"], "left"))
    own = F.coalesce("_p", "_i", "_n")
    return j.select(*scopes.columns, F.when(F.col("locked"), F.col("_n")).otherwise(own)
                    .alias("value"),
                    (F.col("locked") & (F.col("_p").isNotNull() | F.col("_i").isNotNull()))
                    .alias("refused"))


def merge_calendars(national: DataFrame, local: DataFrame) -> DataFrame:
    """National events untouched plus institution milestones that are not national events."""
    own = local.join(national.select("event"), "event", "left_anti")
    return national.withColumn("scope", F.lit("NATIONAL")).unionByName(
        own.withColumn("scope", F.col("scope")), allowMissingColumns=True)


def expand_templates(activities: DataFrame, templates: DataFrame) -> DataFrame:
    """Template tasks of each activity as editable rows; activities without template stay."""
    return activities.join(templates, "execution_mode", "left").select(
        "activity_id", "execution_mode", "step", "task_label",
        F.expr("date_add(start_date, coalesce(offset_days, 0))").alias("task_date"),
        F.lit(True).alias("editable"))


def object_360(activities: DataFrame, lines: DataFrame, payments: DataFrame,
               page: int = 1000) -> DataFrame:
    """Nested view per activity: tasks and costing, budget, procurement, execution.

    Tasks come in pages of bounded length, so an activity with very many lines spans several
    rows instead of one oversized array; the totals repeat on each page.
    """
    order = [F.col(c) for c in ("seq", "resource_id", "supplier_id", "total", "work_date")]
    paged = windowed(lines, ["activity_id"], order, _r=("row_number",)).withColumn(
        "page", F.floor((F.col("_r") - 1) / page))
    tasks = paged.groupBy("activity_id", "page").agg(F.array_sort(F.collect_list(
        F.struct("seq", "resource_id", "supplier_id", "total", "line_status"))).alias("tasks"))
    bought = lines.groupBy("activity_id", "supplier_id").agg(
        F.sum("total").alias("_t"), F.count(F.lit(1)).alias("_n")).groupBy("activity_id").agg(
        F.struct(F.sum("_n").alias("n_lines"), F.sum("_t").cast(MONEY).alias("cost")).alias("costing"),
        F.struct(F.count(F.lit(1)).alias("n_contracts"), F.max("_t").cast(MONEY).alias("largest"))
        .alias("procurement"))
    done = payments.filter(~F.col("rejected")).groupBy("activity_id").agg(
        F.struct(F.sum("amount").cast(MONEY).alias("paid"), F.max("pay_date").alias("last"))
        .alias("execution"))
    return (activities.join(tasks, "activity_id", "left").join(bought, "activity_id", "left")
            .join(done, "activity_id", "left"))


def orphan_references(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """References to objects that do not exist, counted per missing key."""
    used = child.groupBy(key).agg(F.count(F.lit(1)).alias("n_references"))
    return used.join(parent.select(key), key, "left_anti")
