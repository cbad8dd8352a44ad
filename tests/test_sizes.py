"""Tables that files or plans make look small: none of them may go through the driver."""

import pytest
from pyspark.sql import functions as F

from sparseframe.operators import optimize, solve
from sparseframe.sources import builders as B


@pytest.fixture
def small_broadcasts(spark):
    """A table of over 9 MB in memory that is broadcast fails. What is measured at run time isn't broadcast: its maps take whole pages of memory."""
    held = {"spark.sql.maxBroadcastTableSize": "9m", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k in held:
        spark.conf.unset(k)


def sides(a, trans):
    """What the known solution j % 5 + 1 gives."""
    return a.op(trans).entries.groupBy("i").agg(F.sum(F.col("v") * (F.col("j") % 5 + 1)).alias("v"))


def wrong(x):
    return x.where(F.col("v") != F.col("i") % 5 + 1).count()


def twos(spark, m):
    return spark.range(m).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(2.0).alias("v"))


@pytest.mark.parametrize("trans", ["N", "T"])
def test_places_of_many_rows_are_not_broadcast(spark, small_broadcasts, trans):
    n, m = 400_000, 400_010
    rows = spark.range(n).select((F.col("id") % 10 + n).alias("i"), F.col("id").alias("j"), F.lit(3.0).alias("v"))
    a = B.from_table(rows.unionByName(twos(spark, m)), m, m, duplicates="unique")
    parts = spark.range(m).select(F.col("id").alias("i"), F.when(F.col("id") < n, F.expr("id div 5000")).otherwise(-1).cast("int").alias("part"))
    y = sides(a, trans).withColumn("rhs", F.lit(0).cast("long"))
    x = solve.spsm_parts(a, parts, y, -1, trans=trans)
    assert x.count() == m and wrong(x) == 0


def test_positions_of_long_columns_are_not_broadcast(spark, small_broadcasts):
    m, n = 400_000, 3
    ptr = spark.range(n + 1).select(F.col("id").alias("j"), (F.col("id") * m).alias("ptr"))
    entries = spark.range(m * n).select(F.col("id").alias("pos"), (F.col("id") % m).alias("i"), F.col("id").cast("double").alias("v"))
    a = B.from_csc_tables(ptr, entries, m, n)
    assert a.entries.agg(F.count("*"), F.count_if(F.col("v") == F.col("j") * m + F.col("i"))).first() == (m * n, m * n)


def tiers(spark, n, low):
    """Rows n, n + 1, ... n + 9 depend on all rows before n (low), or these on them."""
    i, j = F.col("id") % 10 + n, F.col("id")
    a = B.from_table(spark.range(n).select(i.alias("i"), j.alias("j"), F.lit(3.0).alias("v")).unionByName(twos(spark, n + 10)), n + 10, n + 10, duplicates="unique")
    return a if low else a.transpose()


@pytest.mark.parametrize("trans", ["N", "T"])
def test_levels_of_many_rows_are_not_broadcast(spark, small_broadcasts, trans):
    a = tiers(spark, 400_000, True)
    x = solve.spsv(a, sides(a, trans), trans=trans)
    assert x.count() == a.m and wrong(x) == 0


def test_prepared_levels_of_many_rows_are_not_broadcast(spark, small_broadcasts):
    a = tiers(spark, 400_000, True).hint("spsv_operation", "T").hint("spsv_strategy", "levels")
    ready, y = optimize.spsv_optimize(a), sides(a, "T")
    assert ready.method == "levels" and sorted(ready.sizes) == [10, 400_000]
    first = solve.spsv(ready, y, 2.0)
    assert first.where(F.col("v") != 2 * (F.col("i") % 5 + 1)).count() == 0
    x = solve.spsv(ready, first.select("i", (F.col("v") / 2).alias("x")).hint("merge").join(y, "i").select("i", "v"))
    assert x.count() == a.m and wrong(x) == 0


def test_upper_levels_of_many_rows_are_not_broadcast(spark, small_broadcasts):
    a = tiers(spark, 400_000, False)
    x = solve.spsv(a, sides(a, "N"), method="levels")
    assert x.count() == a.m and wrong(x) == 0
