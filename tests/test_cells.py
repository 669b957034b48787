"""Running values by cells against plain windows, and how their work is dealt."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ticklake.operators import cells


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(3)
    # one key holds nine tenths; times repeat and some are negative
    out = [(0 if rnd.random() < 0.9 else rnd.randrange(1, 4), rnd.randrange(-50, 400), i, rnd.choice([None, rnd.randrange(100)])) for i in range(3000)]
    return spark.createDataFrame(out, "k int, t bigint, i bigint, v bigint").cache()


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_running_equals_windows(rows, width):
    by = Window.partitionBy("k").orderBy("t", "i")
    before, upto = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.unboundedPreceding, 0)
    v = F.col("v")
    want = rows.withColumns({
        "a": F.last(v, ignorenulls=True).over(before), "b": F.sum(v).over(upto), "c": F.max(v).over(before), "n": F.row_number().over(by).cast("bigint"), "p": F.lag(F.struct("v")).over(by),
    })
    got = cells.running(rows, "k", ["t", "i"], cells.cell("t", width), a=cells.last(v), b=cells.total(v, True), c=cells.most(v), n=cells.total(F.lit(1).cast("bigint"), True), p=cells.last(F.struct("v")))
    key = lambda r: r.i
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)


def test_nearest_ranks(rows):
    got = {r.k: (r.p500, r.p990) for r in cells.nearest_ranks(rows, "k", "v", {"p500": 500, "p990": 990}, 10).collect()}
    by = {}
    for r in rows.where("v is not null").collect():
        by.setdefault(r.k, []).append(r.v)
    want = {k: tuple(sorted(v)[-(-len(v) * m // 1000) - 1] for m in (500, 990)) for k, v in by.items()}
    assert got == want


def test_a_hot_key_is_many_tasks(spark):
    """One instrument alone: no partition of the windowed rows holds most of them."""
    ticks = spark.range(64_000).select(F.lit(1).alias("k"), (F.col("id") * 1000).alias("t"), F.col("id").alias("i"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        got = cells.running(ticks, "k", ["t", "i"], cells.cell("t", 100_000), n=cells.total(F.lit(1), True))
        sizes = sorted(r["count"] for r in got.where("n > 0").groupBy(F.spark_partition_id().alias("p")).count().collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_empty(spark, rows):
    none = rows.where("false")
    assert cells.running(none, "k", ["t", "i"], cells.cell("t", 10), a=cells.last(F.col("v"))).count() == 0
