"""Window operators. Groups that grow with the data go through ``windowed``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import ratio
from ..scale import percentiles, pick, windowed

MONEY = "decimal(18,2)"


def build_scd2(changes: DataFrame, key: str, dated: str, ident: str) -> DataFrame:
    """Versions per object: each closes where the next begins and names the one it supersedes."""
    order = [F.col(dated), F.col(ident)]
    out = windowed(changes, [key], order, version=("row_number",), valid_to=("lead", dated),
                   supersedes_id=("lag", ident))
    return out.withColumnRenamed(dated, "valid_from")


def validity_gaps(versions: DataFrame, key: str, ident: str) -> DataFrame:
    """Gaps and overlaps between consecutive versions of an object."""
    nxt = windowed(versions, [key], [F.col("valid_from"), F.col(ident)],
                   next_from=("lead", "valid_from"))
    days = F.date_diff("next_from", "valid_to")
    return (nxt.filter(F.col("next_from").isNotNull() & F.col("valid_to").isNotNull())
            .withColumn("days", days).filter(F.col("days") != 0)
            .withColumn("issue", F.when(F.col("days") > 0, "GAP").otherwise("OVERLAP")))


def latest_version(versions: DataFrame, key: str, order: list[str],
                   official: Column | None = None) -> DataFrame:
    """Current version per object by partial aggregation, optionally among official ones."""
    kept = versions if official is None else versions.filter(official)
    return pick(kept.withColumn("_at", F.struct(*order)), [key], F.col("_at")).drop("_at")


def cash_forecast(monthly: DataFrame, credits: DataFrame, key: str) -> DataFrame:
    """Running consumption and remaining credit per month; one row per key and month comes in."""
    w = W.partitionBy(key).orderBy("month").rowsBetween(W.unboundedPreceding, 0)
    out = monthly.withColumn("cumulative", F.sum("amount").over(w).cast("decimal(20,2)"))
    return out.join(credits, key).withColumn("remaining", F.col("credit") - F.col("cumulative"))


def price_gap(lines: DataFrame, limit: float) -> DataFrame:
    """Proposed against reference price; a gap above the limit asks for a justification."""
    gap = ratio(F.col("unit_cents") - F.col("ref_cents"), F.col("ref_cents"))
    return lines.withColumn("gap", gap).withColumn(
        "justify", F.coalesce(F.col("gap") > limit, F.lit(False)))


def price_anomalies(lines: DataFrame, prices: DataFrame, limit: float, mad_factor: float
                    ) -> DataFrame:
    """Lines whose unit price departs from the median of their resource by the MAD rule, with
    the gap to the reference price."""
    med = percentiles(lines, ["resource_id"], "unit_cents", median=0.5)
    spread = lines.join(med, "resource_id").withColumn(
        "_dev2", F.abs(2 * F.col("unit_cents") - (2 * F.col("median")).cast("long")))
    mad = percentiles(spread, ["resource_id"], "_dev2", mad2=0.5)
    out = spread.join(mad, "resource_id").join(prices, "resource_id")
    flagged = out.filter(F.col("_dev2") > mad_factor * F.col("mad2")).drop("_dev2")
    return price_gap(flagged, limit)


def anti_splitting(needs: DataFrame, keys: list[str], threshold: int, days: int) -> DataFrame:
    """Days on which small needs of one structure and nature add up across the threshold.

    Amounts are combined per day first; the window then holds at most one row per calendar day.
    """
    small_needs = needs.filter(F.col("total") < threshold)
    daily = small_needs.groupBy(*keys, "work_date").agg(
        F.sum("total").cast(MONEY).alias("_day"), F.count(F.lit(1)).alias("_n"))
    no = F.date_diff("work_date", F.lit("1970-01-01").cast("date"))
    w = W.partitionBy(*keys).orderBy("_no").rangeBetween(-days, 0)
    out = daily.withColumn("_no", no).withColumn("window_total", F.sum("_day").over(w)).withColumn(
        "n_needs", F.sum("_n").over(w))
    return (out.filter((F.col("window_total") >= threshold) & (F.col("n_needs") > 1))
            .drop("_no", "_day", "_n"))


def price_level_rank(offers: DataFrame, key: str, supplier: str, value: str) -> DataFrame:
    """Percent rank and decile of each supplier's lowest price inside its resource."""
    best = offers.groupBy(key, supplier).agg(F.min(value).alias(value))
    out = windowed(best, [key], [F.col(value)], _r=("rank",), _n=("size",))
    out = windowed(out, [key], [F.col(value), F.col(supplier)], _rn=("row_number",))
    share = F.when(F.col("_n") > 1, (F.col("_r") - 1) / (F.col("_n") - 1)).otherwise(F.lit(0.0))
    # the first n % 10 tiles hold one row more, as ntile does
    small_tile, extra = F.floor(F.col("_n") / 10), F.col("_n") % 10
    cut = extra * (small_tile + 1)
    tile = (F.when(F.col("_rn") <= cut, F.floor((F.col("_rn") - 1) / (small_tile + 1)) + 1)
            .otherwise(extra + F.floor(F.try_divide(F.col("_rn") - cut - 1, small_tile)) + 1))
    return out.select(key, supplier, value, share.alias("percent_rank"),
                      tile.cast("int").alias("decile"))


def prioritise_projects(projects: DataFrame, portfolio: str, score: Column, ident: str
                        ) -> DataFrame:
    """Rank inside the portfolio: mandatory first, then by score, then by id."""
    scored = projects.withColumn("priority_score", score)
    return windowed(scored, [portfolio],
                    [F.when(F.col("mandatory"), 0).otherwise(1), -F.col("priority_score"),
                     F.col(ident)], rank=("row_number",))


def indicator_trend(series: DataFrame, key: str, period: str, value: str) -> DataFrame:
    """Change on the previous period and moving mean of three; one row per key and period."""
    w = W.partitionBy(key).orderBy(period)
    return (series.withColumn("change", F.col(value) - F.lag(value).over(w))
            .withColumn("moving_mean", F.avg(value).over(w.rowsBetween(-2, 0))))


def target_trajectory(results: DataFrame, key: str, period: str) -> DataFrame:
    """Baseline, straight line to the last target and actual value per period."""
    w = W.partitionBy(key).orderBy(period)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first, last = F.first(period).over(whole), F.last(period).over(whole)
    goal = F.last("target").over(whole)
    share = F.try_divide(F.col(period) - first + 1, last - first + 1)
    return results.select(key, period, "baseline", "actual",
                          (F.col("baseline") + (goal - F.col("baseline")) * share)
                          .alias("trajectory"))


def performance_gap(results: DataFrame) -> DataFrame:
    """Actual minus target, read by the direction of the indicator: negative means behind."""
    gap = F.when(F.col("direction") == "LOWER", F.col("target") - F.col("actual")).otherwise(
        F.col("actual") - F.col("target"))
    return results.withColumn("gap", gap).withColumn("behind", F.col("gap") < 0)


def forecast_indicator(series: DataFrame, keys: list[str], x: str, y: str, horizon: int
                       ) -> DataFrame:
    """Linear forecast at ``horizon`` periods after the last one, labelled as a forecast."""
    fit = series.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.max(x).alias("_last"), F.count(F.lit(1)).alias("n_points"))
    return fit.select(*keys, "n_points", F.round("slope", 6).alias("slope"),
                      (F.col("_last") + horizon).alias("period"),
                      F.round(F.col("intercept") + F.col("slope") * (F.col("_last") + horizon), 4)
                      .alias("forecast"), F.lit("FORECAST").alias("label"))


def recurrent_activities(activities: DataFrame, keys: list[str], year: str, span: int = 2
                         ) -> DataFrame:
    """Runs of consecutive years per activity kind, at least ``span`` long."""
    years = activities.groupBy(*keys, year).agg(F.count(F.lit(1)).alias("_n"),
                                                F.sum("allocation").alias("_a"))
    w = W.partitionBy(*keys).orderBy(year)
    island = F.col(year) - F.row_number().over(w)
    return (years.withColumn("_island", island).groupBy(*keys, "_island").agg(
        F.min(year).alias("first_year"), F.max(year).alias("last_year"),
        F.sum("_n").alias("n_activities"), F.sum("_a").cast(MONEY).alias("amount"))
        .filter(F.col("last_year") - F.col("first_year") + 1 >= span).drop("_island"))


def deadline_status(tasks: DataFrame, today: str, keys: list[str], order: list[Column]
                    ) -> DataFrame:
    """Days left, late tasks, and tasks at risk because a predecessor of the sequence is late."""
    day = F.lit(today).cast("date")
    late = (~F.col("done")) & (F.col("deadline") < day)
    marked = tasks.withColumn("days_left", F.date_diff("deadline", day)).withColumn(
        "late", late).withColumn("_late", late.cast("int"))
    out = windowed(marked, keys, order, _before=("max_before", "_late"))
    return out.withColumn("at_risk", (~F.col("done")) & (
        F.coalesce("_before", F.lit(0)) == 1)).drop("_late", "_before")


def audit_changes(log: DataFrame, obj: str, order: list[Column], fields: list[str]) -> DataFrame:
    """State before and after each change of an object; the first record has no before."""
    packed = log.withColumn("_state", F.struct(*fields))
    out = windowed(packed, [obj], order, _before=("lag", "_state"))
    return out.select(*log.columns, *[F.col(f"_before.{f}").alias(f"{f}_before") for f in fields])


def chain_hashes(log: DataFrame, stream: str, order: list[Column], content: Column) -> DataFrame:
    """Seal a log: each record stores the hash of its predecessor's content and of its own."""
    own = log.withColumn("own_hash", F.sha2(content, 256))
    linked = windowed(own, [stream], order, previous_hash=("lag", "own_hash"))
    return linked.withColumn("link", F.sha2(F.concat_ws(
        "|", F.coalesce("previous_hash", F.lit("")), "own_hash"), 256))


def verify_audit_chain(sealed: DataFrame, stream: str, order: list[Column], content: Column
                       ) -> DataFrame:
    """Records that were altered, and records whose predecessor is missing or altered."""
    fresh = sealed.withColumn("_own", F.sha2(content, 256))
    now = windowed(fresh, [stream], order, _prev=("lag", "own_hash"))
    altered = F.col("_own") != F.col("own_hash")
    broken = ~F.col("_prev").eqNullSafe(F.col("previous_hash"))
    relinked = F.col("link") != F.sha2(F.concat_ws(
        "|", F.coalesce("previous_hash", F.lit("")), "own_hash"), 256)
    return now.withColumn("altered", altered | relinked).withColumn(
        "predecessor_missing", broken).filter(
        F.col("altered") | F.col("predecessor_missing")).drop("_own", "_prev")


def islands(df: DataFrame, keys: list[str], order: list[Column], same: list[str]) -> DataFrame:
    """Number the runs of equal values: ``island`` grows whenever one of ``same`` changes."""
    packed = df.withColumn("_v", F.struct(*same))
    lagged = windowed(packed, keys, order, _prev=("lag", "_v"))
    flagged = lagged.withColumn("_new", (~F.col("_prev").eqNullSafe(F.col("_v"))).cast("long"))
    return windowed(flagged, keys, order, island=("sum", "_new")).drop("_v", "_prev", "_new")


def repeat_runs(runs: DataFrame, actor: str, order: list[Column], same: list[str], n: int
                ) -> DataFrame:
    """Runs of at least ``n`` equal calls in a row."""
    numbered = islands(runs, [actor], order, same)
    return numbered.groupBy(actor, "island", *same).agg(
        F.count(F.lit(1)).alias("n_calls"), F.min("event_id").alias("first_event"),
        F.max("event_id").alias("last_event")).filter(F.col("n_calls") >= n).drop("island")


def budget_exceeded_runs(runs: DataFrame, keys: list[str], order: list[Column],
                         max_steps: int, max_cost: str) -> DataFrame:
    """First step at which a run passes its limit of steps or cost."""
    out = windowed(runs, keys, order, step=("row_number",), spent=("sum", "cost"))
    over = (F.col("step") > max_steps) | (F.col("spent") > F.lit(max_cost).cast(MONEY))
    hits = out.filter(over).withColumn("reason", F.when(F.col("step") > max_steps, "steps")
                                       .otherwise("cost"))
    return pick(hits, keys, F.col("step"), latest=False)


def state_transitions(log: DataFrame, obj: str, order: list[Column], state: str, at: str,
                      allowed: DataFrame) -> DataFrame:
    """Every change of state with the time spent before it and whether the change is allowed."""
    prev = windowed(log, [obj], order, from_state=("lag", state), _since=("lag", at))
    moves = prev.filter(F.col("from_state").isNotNull()
                        & (F.col("from_state") != F.col(state))).withColumnRenamed(state, "to_state")
    seconds = (F.unix_micros(F.col(at).cast("timestamp"))
               - F.unix_micros(F.col("_since").cast("timestamp")))
    legal = allowed.withColumn("legal", F.lit(True))
    return (moves.withColumn("micros", seconds).drop("_since")
            .join(legal, ["from_state", "to_state"], "left")
            .withColumn("legal", F.coalesce("legal", F.lit(False))))


def lifecycle_funnel(projects: DataFrame, stages: list[str]) -> DataFrame:
    """Projects that reached each stage and the conversion from the stage before."""
    counts = projects.groupBy("stage").agg(F.count(F.lit(1)).alias("_n"))
    # at most one row per stage: the ordering window is over the list of stages only
    reached = counts.withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("stage")))).groupBy(
        "_s").agg(F.sum("_n").alias("n_reached"))
    w = W.partitionBy(F.lit(1)).orderBy("_s")
    names = F.array(*[F.lit(s) for s in stages])
    return reached.select(F.col("_s").alias("stage_no"),
                          F.element_at(names, F.col("_s") + 1).alias("stage"), "n_reached",
                          ratio(F.col("n_reached"), F.lag("n_reached").over(w))
                          .alias("conversion"))
