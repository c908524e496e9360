"""Streams to their end: last windows, open deadlines, late rows, several batches."""

import datetime as dt
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fiscalarc.session import work_dir
from fiscalarc.streaming import streams

SCHEMA = "event_id long, ts timestamp, actor long, kind string, value decimal(18,2)"
DAY = dt.datetime(2024, 1, 1)


def at(minutes):
    return DAY + dt.timedelta(minutes=minutes)


def feed(spark, *batches):
    """A stream that brings each list of rows in a batch of its own."""
    source = work_dir(spark, "source")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        import time
        time.sleep(0.05 if i + 1 < len(batches) else 0)  # files are read in order of their time
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)


def closed(spark, stream, build, **values):
    markers, target = work_dir(spark, "end"), work_dir(spark, "out")
    out = build(lambda s: streams.with_end(s, markers, **values))
    streams.drain_closed(out, target, work_dir(spark, "check"), markers)
    return spark.read.schema(out.schema).parquet(target).collect()


@pytest.fixture(scope="module", autouse=True)
def utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def rows(seed=1, n=80):
    rng = random.Random(seed)
    out = [(i, at(rng.randrange(0, 600)), rng.choice([1, 1, 1, 2, None]), rng.choice(["a", "b", None]), Decimal(3))
           for i in range(n)]
    return sorted(out, key=lambda r: r[1])


def test_all_windows_come_back(spark):
    data = rows()
    data.append((99, data[-1][1], 1, "a", Decimal(1)))  # a tie at the very end
    got = closed(spark, None, lambda end: streams.tumbling(
        end(feed(spark, data[:40], data[40:])), "1 hour", "2 days", ["kind"]))
    want = Counter((r[1].replace(minute=0), r[3]) for r in data)
    assert {(r["w"]["start"], r["kind"]): r["n"] for r in got} == dict(want)


def test_sessions_end_and_hot_actors_are_whole(spark):
    data = rows(2)
    got = closed(spark, None, lambda end: streams.sessions(end(feed(spark, data)), "30 minutes", "10 minutes", "actor"))
    want = Counter()
    for actor in {r[2] for r in data}:
        last = None
        for _, ts, *_ in sorted((r for r in data if r[2] == actor), key=lambda r: r[1]):
            first = ts if last is None or ts - last >= dt.timedelta(minutes=30) else first
            want[actor, first] += 1
            last = ts
    assert {(r["actor"], r["w"]["start"]): r["n"] for r in got} == dict(want)


def test_late_rows_are_counted(spark):
    first = [(i, at(600 + i), 1, "a", Decimal(1)) for i in range(5)]
    late = [(10, at(0), 1, "a", Decimal(1)), (11, at(595), 1, "a", Decimal(1))]  # the second is inside the delay
    same = [(20, at(604), 1, "a", Decimal(1))]
    got = closed(spark, None, lambda end: streams.tumbling(
        end(feed(spark, first, same, late)), "1 hour", "10 minutes", ["kind"]))
    target = work_dir(spark, "late")
    streams.label_late(feed(spark, first, same, late), "10 minutes", target, work_dir(spark, "check"), only=True)
    side = spark.read.parquet(f"{target}/rows").collect()
    assert [r["event_id"] for r in side] == [10]
    assert sum(r["n"] for r in got) + len(side) == 8


def test_unanswered_items_up_to_the_end(spark):
    opened = [(1, at(0), 1, "o", None), (2, at(5), 2, "o", None), (3, at(5), 2, "o", None), (4, at(90), 3, "o", None),
              (5, at(100), None, "o", None)]
    answers = [(6, at(20), 1, "x", None), (7, at(100), 2, "x", None)]
    late = [(8, at(92), 3, "x", None)]  # behind the newest row, but inside the delay
    def run(opened, *batches):
        markers, target = work_dir(spark, "end"), work_dir(spark, "out")
        left = streams.with_end(feed(spark, opened), markers)
        right = streams.with_end(feed(spark, *batches), markers)
        out = streams.deadlines(left, right, "actor", "1 hour", "10 minutes")
        streams.drain_closed(out, target, work_dir(spark, "check"), markers)
        return sorted(r["event_id"] for r in spark.read.schema(out.schema).parquet(target).collect())

    assert run(opened, answers, late) == [2, 3, 5]
    assert run(opened, []) == [1, 2, 3, 4, 5] and run([], answers) == []


def test_the_first_crossing_is_told_once(spark):
    def event(i, minutes, kind, value):
        return (i, at(minutes), 1, kind, Decimal(value))

    batches = [[event(1, 0, "a", 6), event(2, 1, "a", 5), event(3, 1, "b", 1), event(4, 2, None, 50)],
               [event(5, 3, "a", -9), event(6, 4, "a", 20), event(7, 4, "b", 99), event(8, 4, "b", 99)],
               [event(9, 5, "c", 1000), event(10, 6, "b", 1)]]
    ceilings = spark.sql("SELECT * FROM VALUES ('a', 10), ('b', 50), (null, 40) AS t(kind, ceiling)")
    target = work_dir(spark, "envelope")
    streams.envelope(feed(spark, *batches), "kind", ceilings, target, work_dir(spark, "check"))
    alerts = spark.read.parquet(f"{target}/alerts").collect()
    assert sorted((str(r["kind"]), r["event_id"], int(r["used"])) for r in alerts) == [
        ("None", 4, 50), ("a", 2, 11), ("b", 7, 100)]
    totals = spark.read.parquet(f"{target}/totals/batch=2").collect()
    assert {r["kind"]: (int(r["used"]), r["alerted"]) for r in totals} == {
        "a": (22, True), "b": (200, True), None: (50, True), "c": (1000, False)}
    changed = spark.read.parquet(f"{target}/changes").filter("batch = 2").collect()
    assert {r["kind"]: r["over_ceiling"] for r in changed} == {"b": True, "c": None}


def test_versions_are_kept_in_buckets(spark):
    data = [(i, at(i), i % 7 if i % 5 else None, "k", Decimal(1)) for i in range(40)]
    target = work_dir(spark, "scd2")
    stream = feed(spark, data[:20], data[20:21], data[21:])
    streams.cdc_scd2(stream, "actor", "ts", "event_id", ["kind"], target, work_dir(spark, "check"), buckets=5)
    got = {r["event_id"]: (r["version"], r["supersedes_id"], r["valid_to"])
           for r in streams.read_scd2(spark, target).collect()}
    want = {}
    for actor in {r[2] for r in data}:
        own = [r for r in data if r[2] == actor]
        for n, r in enumerate(own):
            want[r[0]] = (n + 1, own[n - 1][0] if n else None, own[n + 1][1] if n + 1 < len(own) else None)
    assert got == want
    second = spark.read.parquet(f"{target}/rows").filter("batch = 1").select("bucket").distinct().count()
    assert second == 1  # one change writes one bucket
    with pytest.raises(ValueError):
        streams.cdc_scd2(stream, "nobody", "ts", "event_id", [], target, work_dir(spark, "check"))
