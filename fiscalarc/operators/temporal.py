"""As-of matching in one ordered pass per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import windowed


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str,
          payload: list[str], strict: bool = False) -> DataFrame:
    """Attach to each left row the payload of the latest right row at or before its time.

    ``right`` holds one row per key and time. Both sides are merged into one ordered stream per
    key and the latest right row is carried forward as a running maximum, so the work is linear:
    no range join, and hot keys are sliced by ``windowed``.
    """
    fields = F.struct(F.col(right_time).alias("_t"), *[F.col(p) for p in payload])
    r = right.select(*keys, F.col(right_time).alias("_time"), fields.alias("_p"),
                     F.lit(None).alias("_row"), F.lit(1 if strict else 0).alias("_turn"))
    l = left.select(*keys, F.col(left_time).alias("_time"), F.lit(None).alias("_p"),
                    F.struct(*left.columns).alias("_row"),
                    F.lit(0 if strict else 1).alias("_turn"))
    merged = r.unionByName(l)
    carried = windowed(merged, keys, [F.col("_time"), F.col("_turn")], _last=("max", "_p"))
    return (carried.filter(F.col("_row").isNotNull())
            .select("_row.*", F.col("_last._t").alias(f"as_of_{right_time}"),
                    *[F.col(f"_last.{p}").alias(p) for p in payload]))
