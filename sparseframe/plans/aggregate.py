"""Sums by key, in any order or in a fixed one; prefix sums that need no single partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import DType
from .meta import get_reproducibility

#: Terms of one key folded in a row in the reproducible mode, and rows in a chunk of a prefix sum.
FOLD_TERMS, PREFIX_ROWS = 4096, 1 << 16


def sum_by(rows: DataFrame, keys: list[str], order: str, value: Column, dt: DType) -> DataFrame:
    """(keys, v): the sum of `value` for each key. In the reproducible mode terms are added in the order of `order`,
    in chunks of FOLD_TERMS consecutive indices whose sums are then added in order: bounded memory, one result."""
    if get_reproducibility() == "default":
        return rows.groupBy(*keys).agg(dt.sum(value).alias("v"))
    chunked = rows.withColumn("_c", F.floor(F.col(order) / FOLD_TERMS)).withColumn("_p", value)
    terms = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_p").alias("p"))))
    partial = chunked.groupBy(*keys, "_c").agg(terms.alias("_t")).withColumn("_s", dt.fold(F.col("_t"), lambda e: e["p"]))
    chunks = F.array_sort(F.collect_list(F.struct("_c", "_s")))
    return partial.groupBy(*keys).agg(chunks.alias("_t")).select(*keys, dt.fold(F.col("_t"), lambda e: e["_s"]).alias("v"))


def prefix_sums(counts: DataFrame, size: int) -> DataFrame:
    """counts (i, c) for i in 0..size-1, some missing -> (i, ptr) for i in 0..size: the sum of c before i.

    Chunks of PREFIX_ROWS indices are summed, the chunks' own prefix sums (one row for each
    PREFIX_ROWS) are windowed, and each chunk is windowed by itself.
    """
    spark = counts.sparkSession
    full = spark.range(size + 1).withColumnRenamed("id", "i").join(counts, "i", "left").select("i", F.coalesce("c", F.lit(0)).cast("long").alias("c"), F.floor(F.col("i") / PREFIX_ROWS).alias("k"))
    chunks = full.groupBy("k").agg(F.sum("c").alias("t"))
    before = chunks.select("k", F.coalesce(F.sum("t").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = F.coalesce(F.sum("c").over(Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return full.withColumn("inner", inner).join(before, "k").select("i", (F.col("base") + F.col("inner")).alias("ptr"))
