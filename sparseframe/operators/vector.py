"""Sparse vectors (i, v) of length n, and their meetings with dense ones: DataFrames (i, v) with every i of 0..n-1."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import DType, dtype
from ..plans.meta import InputParameterError, check_base


@dataclass(frozen=True)
class SparseVector:
    entries: DataFrame
    n: int
    dtype: DType
    index_base: int = 0

    def query(self) -> dict[str, int]:
        return {"index_base": self.index_base, "n": self.n, "nnz": self.entries.count()}

    def export(self) -> DataFrame:
        """(i, v) in the vector's index base, ordered."""
        return self.entries.select((F.col("i") + self.index_base).alias("i"), "v").orderBy("i")

    def update(self, changes: DataFrame) -> SparseVector:
        """changes (i, v[, pos]) of stored entries; the last of an entry counts; any other index is an error and changes nothing."""
        pos = F.col("pos") if "pos" in changes.columns else F.monotonically_increasing_id()
        new = changes.select((F.col("i") - self.index_base).cast("long").alias("i"), "v", pos.alias("pos")).groupBy("i").agg(F.max_by("v", "pos").alias("u"))
        if new.join(self.entries, "i", "left_anti").limit(1).count():
            raise InputParameterError("an update of an entry that is not stored", 3)
        v = F.when(F.col("u").isNotNull(), self.dtype.store(F.col("u"))).otherwise(F.col("v"))
        return SparseVector(self.entries.join(new, "i", "left").select("i", v.alias("v")), self.n, self.dtype, self.index_base)

    def scatter(self) -> DataFrame:
        """The dense vector."""
        spark = self.entries.sparkSession
        v = F.when(F.col("v").isNull(), self.dtype.store(self.dtype.zero)).otherwise(F.col("v"))
        return spark.range(self.n).withColumnRenamed("id", "i").join(self.entries, "i", "left").select("i", v.alias("v"))

    # --- with a dense vector ------------------------------------------------------------
    def dot(self, y: DataFrame, conjugate: bool = False):
        """sum x_i y_i, with x conjugated if asked for; 0 without entries."""
        dt = self.dtype
        x = dt.work(F.col("v"))
        both = self.entries.select("i", (dt.conj(x) if conjugate else x).alias("x")).join(y.select("i", dt.work(F.col("v")).alias("y")), "i")
        got = both.agg(dt.sum(dt.mul(F.col("x"), F.col("y"))).alias("s")).first()["s"]
        if dt.is_complex:
            return complex(got["re"] or 0.0, got["im"] or 0.0)
        return got or 0.0

    def waxpby(self, alpha, beta, y: DataFrame | None) -> DataFrame:
        """The dense vector alpha x + beta y. beta = 0: y is not read; alpha = 0: x is not."""
        dt, spark = self.dtype, self.entries.sparkSession
        x = self.entries.select("i", dt.work(F.col("v")).alias("x")) if alpha != 0 else None
        if beta == 0 or y is None:
            if beta != 0:
                raise InputParameterError("beta is not zero, but there is no y", 4)
            rows, parts = spark.range(self.n).withColumnRenamed("id", "i"), []
        else:
            rows, parts = y.select("i", dt.work(F.col("v")).alias("y")), [dt.mul(dt.lit(beta), F.col("y"))]
        if x is not None:
            rows = rows.join(x, "i", "left")
            parts.insert(0, dt.mul(dt.lit(alpha), dt.coalesce(F.col("x"), dt.zero)))
        v = dt.zero if not parts else parts[0] if len(parts) == 1 else dt.add(*parts)
        return rows.select("i", dt.store(v).alias("v"))

    def axpby(self, alpha, beta, y: DataFrame) -> DataFrame:
        return self.waxpby(alpha, beta, y)

    def rot(self, y: DataFrame, c, s) -> tuple[SparseVector, DataFrame]:
        """Givens rotation at the stored entries: x <- c x + s y, y <- c y - conj(s) x."""
        dt = self.dtype
        conj = complex(s).conjugate() if dt.is_complex else s
        at = y.select("i", dt.work(F.col("v")).alias("y")).join(self.entries.select("i", dt.work(F.col("v")).alias("x")), "i", "left")
        stored = F.col("x").isNotNull()
        new_x = dt.add(dt.mul(dt.lit(c), F.col("x")), dt.mul(dt.lit(s), F.col("y")))
        new_y = dt.sub(dt.mul(dt.lit(c), F.col("y")), dt.mul(dt.lit(conj), F.col("x")))
        xs = at.where(stored).select("i", dt.store(new_x).alias("v"))
        ys = at.select("i", F.when(stored, dt.store(new_y)).otherwise(dt.store(F.col("y"))).alias("v"))
        return SparseVector(xs, self.n, dt, self.index_base), ys


def create(spark: SparkSession, n: int, indx: Sequence[int], vals: Sequence, dt: DType | str = "d", index_base: int = 0) -> SparseVector:
    from ..sources.builders import values_frame

    check_base(index_base, 2)
    if n < 0:
        raise InputParameterError("a negative length", 3)
    dt = dtype(dt)
    e = values_frame(spark, dt, vals, i=[i - index_base for i in indx])
    return SparseVector(e.select("i", dt.store(F.col("v")).alias("v")), n, dt, index_base)


def from_table(entries: DataFrame, n: int, dt: DType | str = "d", index_base: int = 0) -> SparseVector:
    check_base(index_base, 2)
    if n < 0:
        raise InputParameterError("a negative length", 3)
    dt = dtype(dt)
    return SparseVector(entries.select((F.col("i") - index_base).cast("long").alias("i"), dt.store(F.col("v")).alias("v")), n, dt, index_base)


def gather(y: DataFrame, n: int, dt: DType | str = "d") -> SparseVector:
    """The dense vector's entries that are not zero (NaN is not)."""
    dt = dtype(dt)
    return SparseVector(y.where(dt.nonzero(F.col("v"))).select("i", dt.store(F.col("v")).alias("v")), n, dt)


def dense(spark: SparkSession, vals: Sequence, dt: DType | str = "d") -> DataFrame:
    from ..sources.builders import values_frame

    return values_frame(spark, dtype(dt), vals, i=range(len(vals)))
