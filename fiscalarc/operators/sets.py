"""Set operations and unions of signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import severity
from ..scale import pick


def signals(df: DataFrame, kind: str, when: Column, program: str | Column, ident: str | Column,
            probability: Column, impact: Column) -> DataFrame:
    """Rows that meet a condition as early-warning signals."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return df.filter(when).select(
        F.lit(kind).alias("signal_type"), col(program).alias("program"),
        col(ident).cast("string").alias("object_id"),
        probability.cast("int").alias("probability"), impact.cast("int").alias("impact"),
        severity(probability * impact).alias("severity"), F.lit("OPEN").alias("status"))


def early_warnings(parts: list[DataFrame]) -> DataFrame:
    """One signal table from planning, budget, procurement, contract, physical, indicator, risk."""
    return reduce(DataFrame.unionByName, parts)


def master_schedule(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """First and last date and number of items of each phase of a project."""
    tagged = [df.select(key, F.lit(phase).alias("phase"), "start_date", "end_date")
              for phase, df in parts.items()]
    return reduce(DataFrame.unionByName, tagged).groupBy(key, "phase").agg(
        F.min("start_date").alias("first_date"), F.max("end_date").alias("last_date"),
        F.count(F.lit(1)).alias("n_items"))


def missing_in_target(src: DataFrame, dst: DataFrame, keys: list[str]) -> DataFrame:
    """Keys lost on the way, as often as they were lost."""
    return src.select(*keys).exceptAll(dst.select(*keys))


def common_needs(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def dedupe_documents(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """One document per content, the lowest id, with the number of copies; only hashes move."""
    return docs.select(ident, F.sha2(text, 256).alias("hash")).groupBy("hash").agg(
        F.min(ident).alias(ident), F.count(F.lit(1)).alias("n_copies"))


def idempotent_actions(actions: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first action per idempotency key; retries are dropped."""
    return pick(actions, keys, F.col(order), latest=False)


def global_search_index(parts: dict[str, DataFrame]) -> DataFrame:
    """One searchable table; each part brings id, label and text."""
    return reduce(DataFrame.unionByName, [
        df.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), "label", "text")
        for kind, df in parts.items()])
