"""Projections, filters and predicates: narrow work, no shuffle unless a semi join is named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import holds_at, line_cost
from ..scale import top_per_group


def to_canonical(df: DataFrame, mapping: dict[str, tuple[str, str]]) -> DataFrame:
    """Source columns to canonical names and types; unmapped columns are not read."""
    return df.select(*[F.col(src).cast(kind).alias(name) for src, (name, kind) in mapping.items()])


def cost_lines(lines: DataFrame, determinants: list[str] | None = None,
               unit_price: str = "unit_price") -> DataFrame:
    """Cost per line: the adjusted total, or a product of physical determinants and a unit price."""
    if determinants is None:
        return lines.withColumn("cost", line_cost())
    product = F.col(unit_price).cast("decimal(18,2)")
    for d in determinants:
        product = product * F.col(d).cast("decimal(10,0)")
    return lines.withColumn("cost", F.round(product, 2).cast("decimal(18,2)"))


def price_search(prices: DataFrame, label: str | None = None, source: str | None = None,
                 category: str | None = None, low: str | None = None,
                 high: str | None = None) -> DataFrame:
    """Prices by facet; every facet reaches the scan as a pushed filter."""
    out = prices
    if label:
        out = out.filter(F.col("label").contains(label))
    if source:
        out = out.filter(F.col("brand") == source)
    if category:
        out = out.filter(F.col("resource_type") == category)
    if low:
        out = out.filter(F.col("ref_price") >= F.lit(low).cast("decimal(18,2)"))
    if high:
        out = out.filter(F.col("ref_price") <= F.lit(high).cast("decimal(18,2)"))
    return out


def split_execution_mode(lines: DataFrame, internal: Column) -> DataFrame:
    """Internal and external components; only MIXED activities are split, by ``internal``."""
    mode = F.col("execution_mode")
    return lines.withColumn("component", F.when(mode == "DIRECT", "INTERNAL")
                            .when(mode == "INDIRECT", "EXTERNAL")
                            .when(internal, "INTERNAL").otherwise("EXTERNAL"))


def tenant_filter(df: DataFrame, tenant: int | str, column: str = "tenant_id") -> DataFrame:
    """Only the caller's tenant."""
    return df.filter(F.col(column) == F.lit(tenant))


def mask_columns(df: DataFrame, level: Column, clearance: int, hidden: list[str],
                 persons: list[str]) -> DataFrame:
    """Hide values above the clearance; persons become stable pseudonyms either way."""
    out = df
    for c in hidden:
        out = out.withColumn(c, F.when(level <= clearance, F.col(c)))
    for c in persons:
        out = out.withColumn(c, F.substring(F.sha2(F.col(c).cast("string"), 256), 1, 16))
    return out


def effective_permission(requests: DataFrame, user_grants: DataFrame, agent_grants: DataFrame,
                         policy: list[int]) -> DataFrame:
    """user ∩ agent ∩ policy per request; the request is allowed if its tool is inside."""
    joined = requests.join(user_grants, "tenant", "left").join(agent_grants, "agent", "left")
    common = F.array_intersect(F.array_intersect("user_tools", "agent_tools"),
                               F.array(*[F.lit(p) for p in policy]))
    usable = F.coalesce(common, F.array().cast("array<int>"))
    return joined.select(*requests.columns, F.size(usable).alias("n_usable"),
                         F.array_contains(usable, F.col("tool")).alias("allowed"))


def secure_results(hits: DataFrame, grants: DataFrame, key: str, group: list[str],
                   order: list[Column], k: int) -> DataFrame:
    """Drop what the caller may not see before ranking, so no rank leaks a hidden row."""
    return top_per_group(hits.join(grants.select(key), key, "left_semi"), group, order, k)


def valid_at(df: DataFrame, when: str | Column) -> DataFrame:
    """The version of each object valid at a date."""
    when = F.lit(when).cast("date") if isinstance(when, str) else when
    return df.filter(holds_at(when))


def regulatory_filter(docs: DataFrame, when: str, jurisdiction: str) -> DataFrame:
    """Official texts of a jurisdiction in force at a date."""
    return valid_at(docs.filter((F.col("jurisdiction") == jurisdiction) & F.col("official")), when)


def official_only(df: DataFrame, status: str = "status",
                  accepted: tuple[str, ...] = ("CERTIFIED", "VERIFIED"),
                  keep_others: bool = False) -> DataFrame:
    """Certified rows; with ``keep_others`` the rest stays, labelled."""
    official = F.col(status).isin(*accepted)
    if keep_others:
        return df.withColumn("label", F.when(official, "OFFICIAL").otherwise("UNOFFICIAL"))
    return df.filter(official).withColumn("label", F.lit("OFFICIAL"))


def retention_expired(df: DataFrame, retention: DataFrame, today: str, dated: str) -> DataFrame:
    """Rows older than the retention of their data class."""
    limit = F.date_add(F.col(dated), F.col("days"))
    return (df.join(retention, "data_class").withColumn("expired_on", limit)
            .filter(F.col("expired_on") < F.lit(today).cast("date")))


def quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Split by rules that describe bad rows. The bad side keeps the whole row and its reasons, so
    it can be corrected and replayed; an unknown (null) result is not a fault."""
    reasons = F.array_compact(F.array(*[
        F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]))
    tagged = df.withColumn("reasons", reasons)
    ok = tagged.filter(F.size("reasons") == 0).drop("reasons")
    return ok, tagged.filter(F.size("reasons") > 0)


def bulk_edit(df: DataFrame, predicate: Column, changes: dict[str, Column]) -> DataFrame:
    """Change rows by predicate and return before and after side by side; nothing is written."""
    out = df.withColumn("changed", F.coalesce(predicate, F.lit(False)))
    for c, new in changes.items():
        out = out.withColumn(f"{c}_after", F.when(F.col("changed"), new).otherwise(F.col(c)))
    return out
