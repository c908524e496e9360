"""Hot groups: the sliced windows must equal the plain ones."""

import pytest
from pyspark.sql import functions as F

from fiscalarc import scale
from fiscalarc.operators.temporal import as_of


@pytest.fixture
def split(spark):
    """Force slicing on small data."""
    spark.conf.set(scale.SPLIT_MIN_BYTES, "0")
    spark.conf.set(scale.SPLIT_MIN_ROWS, "1000")
    yield
    spark.conf.unset(scale.SPLIT_MIN_BYTES)
    spark.conf.unset(scale.SPLIT_MIN_ROWS)


def skewed(spark):
    n = F.col("id")
    return spark.range(12000).select(
        F.when(n % 3 != 0, n % 40).alias("g"), (n * 7919 % 5003).alias("o"),
        n.alias("id"), (n % 11).alias("v"), F.when(n % 4 == 0, n % 13).alias("m"))


OUTS = dict(rn=("row_number",), size=("size",), total=("sum", "v"), top=("max", "m"),
            before=("sum_before", "v"), best=("max_before", "m"), prev=("lag", "m"), nxt=("lead", "v"))


def test_slices_equal_plain(spark, split):
    df = skewed(spark)
    order = [F.col("o"), F.col("id")]
    cut = scale.windowed(df, ["g"], order, **OUTS)
    spark.conf.set(scale.SPLIT_MIN_BYTES, str(1 << 60))
    plain = scale.windowed(df, ["g"], order, **OUTS)
    assert cut.exceptAll(plain).count() == 0 and cut.count() == plain.count() == 12000


def test_ranks_with_ties(spark, split):
    df = skewed(spark)
    outs = dict(r=("rank",), d=("dense_rank",), n=("size",))
    cut = scale.windowed(df, ["g"], [-F.col("o") % 97], **outs)
    spark.conf.set(scale.SPLIT_MIN_BYTES, str(1 << 60))
    plain = scale.windowed(df, ["g"], [-F.col("o") % 97], **outs)
    assert cut.exceptAll(plain).count() == 0


def test_one_global_group(spark, split):
    df = skewed(spark)
    cut = scale.windowed(df, [], [F.col("o"), F.col("id")], total=("sum", "v"), rn=("row_number",))
    spark.conf.set(scale.SPLIT_MIN_BYTES, str(1 << 60))
    plain = scale.windowed(df, [], [F.col("o"), F.col("id")], total=("sum", "v"), rn=("row_number",))
    assert cut.exceptAll(plain).count() == 0


def test_percentiles_of_a_hot_group(spark, split):
    df = skewed(spark)
    got = {r["g"]: (r["a"], r["b"]) for r in scale.percentiles(df, ["g"], "o", a=0.5, b=0.9).collect()}
    want = df.groupBy("g").agg(F.percentile("o", 0.5).alias("a"), F.percentile("o", 0.9).alias("b"))
    for r in want.collect():
        assert got[r["g"]] == pytest.approx((r["a"], r["b"]))


def test_as_of_with_hot_key(spark, split):
    right = skewed(spark).filter("id % 5 = 0").groupBy("g", "o").agg(F.max("id").alias("p"))
    left = skewed(spark).filter("id % 5 <> 0").select("g", "o", "id")
    for strict in (False, True):
        got = as_of(left, right.withColumnRenamed("o", "t"), ["g"], "o", "t", ["p"], strict)
        op = (lambda a, b: a < b) if strict else (lambda a, b: a <= b)
        r = right.select(F.col("g").alias("g2"), F.col("o").alias("t"), F.col("p"))
        want = left.join(r, F.col("g").eqNullSafe(F.col("g2")) & op(F.col("t"), F.col("o")), "left").groupBy(
            "g", "o", "id").agg(F.max("t").alias("as_of_t"), F.max_by("p", "t").alias("p"))
        assert got.exceptAll(want.select(*got.columns)).count() == 0
        assert got.count() == left.count()


def test_broadcast_is_size_checked(spark):
    tiny, large = spark.sql("SELECT * FROM VALUES (1), (2) AS t(a)"), spark.range(10**9)
    assert "broadcast" in scale.small(tiny)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in scale.small(large)._jdf.queryExecution().logical().toString().lower()


def test_no_copy_without_a_hot_group(spark, split, monkeypatch):
    def none(_):
        raise AssertionError("the input was written")

    monkeypatch.setattr(scale, "cut", none)
    df = skewed(spark).filter("g is not null")  # 8,000 rows, at most 1,000 in a group
    got = scale.windowed(df, ["g"], [F.col("o"), F.col("id")], rn=("row_number",), size=("size",))
    spark.conf.set(scale.SPLIT_MIN_BYTES, str(1 << 60))
    assert got.exceptAll(scale.windowed(df, ["g"], [F.col("o"), F.col("id")], rn=("row_number",), size=("size",))) \
        .count() == 0
    spark.conf.set(scale.SPLIT_MIN_BYTES, "0")
    with pytest.raises(AssertionError, match="written"):
        scale.windowed(skewed(spark), ["g"], [F.col("o")], rn=("row_number",))
