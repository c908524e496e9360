"""User functions: governed SQL formulas, user analysis per group, the passage table function."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from ..operators.retrieval import HEADING


def register_metrics(spark: SparkSession, formulas: list[tuple[str, str]]) -> None:
    """Each governed formula ``a / b`` becomes a SQL function of its columns."""
    for name, formula in formulas:
        if not re.fullmatch(r"[a-z_]+ / [a-z_]+", formula):
            raise ValueError(f"formula not allowed: {formula}")
        num, den = formula.split(" / ")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({num} DOUBLE, {den} DOUBLE) "
                  f"RETURNS DOUBLE RETURN try_divide({num}, {den})")


def grouped_analysis(df: DataFrame, keys: list[str],
                     partial: Callable[[pd.DataFrame], pd.DataFrame], partial_schema: str,
                     merge: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A user analysis per group in two steps, so no task holds a whole group.

    ``partial`` turns a batch of rows into one summary row per group and is applied again to
    combine summaries inside the task; ``merge`` finishes a group from the summaries, at most
    one per task. ``partial`` must therefore accept its own output.
    """
    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            now = partial(batch)
            held = now if held is None else partial(pd.concat([held, now], ignore_index=True))
        if held is not None:
            yield held

    return (df.mapInPandas(summarise, partial_schema).groupBy(*keys)
            .applyInPandas(merge, schema))


@udtf(returnType="passage_no int, section int, start int, fin int, passage string")
class Passages:
    """Table function: a text to its passages, by the rule of ``chunk_documents``."""

    def eval(self, text: str, size: int):
        off = sec = win = number = 0
        current: list = []
        for line in (text or "").split("\n"):
            table = "|" in line and (bool(current) or number > 0)
            heading = not table and re.match(HEADING, line.lower()) is not None
            new_win = win if table else off // size
            if current and (heading or new_win != win):
                yield number, sec, current[0], current[1], "\n".join(current[2])
                number, current = number + 1, []
            sec, win = sec + heading, new_win
            fin = off + len(line)
            current = [current[0], fin, [*current[2], line]] if current else [off, fin, [line]]
            off = fin + 1
        if current:
            yield number, sec, current[0], current[1], "\n".join(current[2])
