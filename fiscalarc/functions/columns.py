"""Column expressions shared by the operators; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(column: Column | str) -> Column:
    """A decimal amount as a double for reports."""
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(20,2)").cast("double")


def ratio(num: Column, den: Column) -> Column:
    """num / den as double, null when the denominator is zero."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def day(column: Column | str) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


def month(column: Column | str) -> Column:
    return F.date_format(column, "yyyy-MM")


def line_cost() -> Column:
    """Line total after adjustment: total * (1 - discount) * (1 + tax), rounded once."""
    one = F.lit(1).cast("decimal(4,2)")
    return F.round(F.col("total") * (one - F.col("discount")) * (one + F.col("tax")), 2).cast(
        "decimal(18,2)")


def severity(score: Column) -> Column:
    return (F.when(score >= 15, "CRITICAL").when(score >= 8, "WARNING").otherwise("INFO"))


def holds_at(when: Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    """Half-open validity: start <= when < end, an absent end means still valid."""
    return (F.col(start) <= when) & (F.col(end).isNull() | (F.col(end) > when))


# Accented letters and their plain forms.
ACCENTS = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def normalise_label(column: Column | str) -> Column:
    """Fold case, accents and spaces, drop punctuation."""
    text = F.translate(F.lower(column), ACCENTS, PLAIN)
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[^a-z0-9 ]", " "), " +", " "))


def tokens(column: Column | str) -> Column:
    """Words of a text, lower case, in order."""
    return F.array_remove(F.split(F.lower(column), r"[^\p{L}\p{N}]+"), "")


def token_set(column: Column | str) -> Column:
    return F.array_distinct(tokens(column))


def extract_keywords(column: Column | str, min_length: int = 4) -> Column:
    """Distinct words of at least ``min_length`` letters, sorted."""
    return F.array_sort(F.filter(token_set(column), lambda w: F.length(w) >= min_length))


def period_bucket(when: Column | str, frequency: str) -> Column:
    """Start of the reporting period that contains a date."""
    when = F.col(when) if isinstance(when, str) else when
    units = {"DAILY": "day", "WEEKLY": "week", "MONTHLY": "month", "QUARTERLY": "quarter",
             "ANNUAL": "year"}
    if frequency in units:
        return F.to_date(F.date_trunc(units[frequency], when))
    if frequency == "SEMI_ANNUAL":
        return F.make_date(F.year(when), F.when(F.month(when) <= 6, 1).otherwise(7), F.lit(1))
    if frequency in ("REAL_TIME", "AD_HOC"):
        return when
    raise ValueError(f"unknown frequency {frequency}")


def calendar_fields(start: Column | str, end: Column | str) -> Column:
    """Quarters touched between two dates, as 'yyyyQn' in order."""
    first = F.to_date(F.date_trunc("quarter", start))
    quarters = F.sequence(first, F.col(end) if isinstance(end, str) else end,
                          F.expr("interval 3 months"))
    return F.transform(quarters, lambda d: F.concat(
        F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string")))


def weighted_progress(value: Column | str, weight: Column | str) -> Column:
    """Weighted mean as an aggregate expression; null when the weights sum to zero."""
    value = F.col(value) if isinstance(value, str) else value
    weight = F.col(weight) if isinstance(weight, str) else weight
    return F.try_divide(F.sum(value * weight).cast("double"), F.sum(weight).cast("double"))
