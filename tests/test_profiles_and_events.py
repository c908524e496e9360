"""Mergeable profiles and decoded broker records."""

import datetime as dt
import random

from pyspark.sql import functions as F

from fiscalarc.operators import aggregates
from fiscalarc.sources import ingest


def test_merged_profiles_are_close_to_the_whole(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(20_000), rng.random() ** 3, None if rng.random() < 0.2 else 7, i % 3) for i in range(60_000)]
    df = spark.createDataFrame(rows, "a long, b double, c int, part int")
    parts = [aggregates.sketch_profile(df.filter(F.col("part") == p), ["a", "b", "c"]) for p in range(3)]
    parts.append(aggregates.sketch_profile(df.limit(0), ["a", "b", "c"]))
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    got = {r["column_name"]: r for r in aggregates.read_profile(aggregates.merge_profiles(merged)).collect()}
    for name, at in (("a", 0), ("b", 1), ("c", 2)):
        values = sorted(r[at] for r in rows if r[at] is not None)
        r = got[name]
        assert (r["n_rows"], r["n_nulls"], r["low"], r["high"]) == (
            60_000, 60_000 - len(values), values[0], values[-1])
        assert abs(r["n_distinct"] - len(set(values))) <= 0.03 * len(set(values))
        assert values[int(0.47 * len(values))] <= r["median"] <= values[int(0.53 * len(values))]
    nothing = aggregates.read_profile(aggregates.sketch_profile(df.limit(0), ["a"])).first()
    assert (nothing["n_rows"], nothing["n_distinct"], nothing["median"]) == (0, 0, None)


def test_broker_records(spark):
    texts = ['{"event_id": 1, "ts": "2024-01-02T03:04:05", "user_id": 9, "event_type": "click", "value": 2.5}',
             '{"event_id": "x"}', "not json", "", None, '{"event_id": 2, "other": 1}', '{"event_id": 1}']
    raw = spark.createDataFrame([(t,) for t in texts], "value string").select(
        F.lit(b"k").alias("key"), F.col("value").cast("binary").alias("value"))
    got = ingest.decode_events(raw, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double")
    assert got.columns == ["event_id", "ts", "user_id", "event_type", "value", "malformed"]
    rows = [tuple(r) for r in got.collect()]
    assert rows[0] == (1, dt.datetime(2024, 1, 2, 3, 4, 5), 9, "click", 2.5, None)
    assert [r[5] for r in rows] == [None, '{"event_id": "x"}', "not json", "", "", None, None]
    assert all(r[:5] == (None,) * 5 for r in rows[1:5]) and rows[5][0] == 2
    assert ingest.decode_events(raw.limit(0), "event_id bigint").collect() == []
