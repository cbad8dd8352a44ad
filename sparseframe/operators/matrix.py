"""The sparse matrix: a DataFrame of (i, j, v), 0-based and unique in (i, j), and what is known of it."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import DType, dtype
from ..plans.meta import Diag, InputParameterError, MatrixMeta, Shape, Trans, check_base, check_shape


class SparseMatrix:
    """Immutable: every operation gives a new matrix with a lazy plan; only scalars come to the driver."""

    def __init__(self, entries: DataFrame, meta: MatrixMeta, held: tuple[DataFrame, ...] = (), terms: DataFrame | None = None):
        """held: frames kept for this matrix, until destroy(). terms: rows (i, j, v) that sum to the entries, if these are sums: enough for what is linear in the matrix and sums anyway."""
        self.entries, self.meta, self.held, self.terms = entries, meta, held, entries if terms is None else terms

    # --- facts ----------------------------------------------------------------------------
    m = property(lambda self: self.meta.m)
    n = property(lambda self: self.meta.n)
    dtype = property(lambda self: self.meta.dtype)
    spark = property(lambda self: self.entries.sparkSession)

    def __repr__(self) -> str:
        return f"SparseMatrix({self.m} x {self.n}, {self.dtype.code}, {self.meta.kind}, {self.meta.layout})"

    def query(self) -> dict[str, int]:
        """Index base, rows, columns and stored entries (zeros count)."""
        nnz = 0 if self.meta.kind == "null" else self.n if self.meta.kind == "identity" else self.entries.count()
        return {"index_base": self.meta.index_base, "m": self.m, "n": self.n, "nnz": nnz}

    def structure(self) -> tuple[Shape, Diag]:
        """Shape by the stored pattern (a diagonal matrix is lower), and the diagonal; one aggregate."""
        dt, i, j, v = self.dtype, F.col("i"), F.col("j"), F.col("v")
        row = self.entries.agg(
            F.coalesce(F.max(i < j), F.lit(False)).alias("above"), F.coalesce(F.max(i > j), F.lit(False)).alias("below"), F.count_if((i == j) & dt.nonzero(v)).alias("full"), F.count_if((i == j) & dt.equals(v, 1.0)).alias("ones")
        ).first()
        square = self.m == self.n
        shape = Shape.RECTANGULAR if not square or (row["above"] and row["below"]) else Shape.UPPER if row["above"] else Shape.LOWER
        diag = Diag.ZERO if not square or row["full"] < self.n else Diag.UNIT if row["ones"] == self.n else Diag.NON_UNIT
        return shape, diag

    def row_counts(self, by: str = "i") -> DataFrame:
        """(i or j, nnz) of the rows or columns that have entries."""
        return self.entries.groupBy(by).agg(F.count("*").alias("nnz"))

    def mgmd(self) -> float:
        """Mean over all rows of exp(sum of the logs of the gaps between neighbouring columns / number of entries): 1 for a row of one entry, 0 for an empty one."""
        if not self.m:
            return 0.0
        gap = F.col("j") - F.lag("j").over(Window.partitionBy("i").orderBy("j"))
        rows = self.entries.select("i", gap.alias("g")).groupBy("i").agg(F.exp(F.coalesce(F.sum(F.ln("g")), F.lit(0.0)) / F.count("*")).alias("g"))
        return (rows.agg(F.sum("g")).first()[0] or 0.0) / self.m

    # --- hints and preparation ------------------------------------------------------------
    def hint(self, name: str, value: Any) -> SparseMatrix:
        return SparseMatrix(self.entries, self.meta.with_(hints=self.meta.hints.with_(name, value)), self.held, self.terms)

    def optimize(self, op: str = "spmv") -> SparseMatrix:
        """Prepares for repeated use: with "many" invocations hinted, entries are dealt by the operation's join key and kept."""
        if self.meta.typeless or self.meta.hints.get(f"{op}_invocations", "many") != "many":
            return self
        trans = self.meta.hints.get(f"{op}_operation", Trans.N)
        key = "j" if trans is Trans.N else "i"
        kept = self.entries.repartition(key).persist()
        return SparseMatrix(kept, self.meta, (kept,))

    def destroy(self) -> None:
        """Releases what was kept for this matrix; plans that read it compute it anew."""
        for kept in (*self.held, self.entries):
            kept.unpersist()

    def copy(self) -> SparseMatrix:
        """The same entries, with nothing of its own to release."""
        return SparseMatrix(self.entries, self.meta)

    # --- element-wise -----------------------------------------------------------------------
    def _changeable(self) -> None:
        if self.meta.no_copy:
            raise InputParameterError("a matrix on the caller's own arrays can't be changed in place", 1)

    def op(self, trans: Trans | str) -> SparseMatrix:
        """op(A) as a matrix: a projection."""
        trans = Trans.of(trans, 2)
        if trans is Trans.N:
            return self
        v = self.dtype.conj(F.col("v")) if trans is Trans.C else F.col("v")
        turned = lambda df: df.select(F.col("j").alias("i"), F.col("i").alias("j"), v.alias("v"))
        return SparseMatrix(turned(self.entries), self.meta.with_(m=self.n, n=self.m), terms=turned(self.terms))

    def transpose(self, trans: Trans | str = Trans.T) -> SparseMatrix:
        self._changeable()
        return self.op(trans)

    def scale(self, alpha) -> SparseMatrix:
        self._changeable()
        if self.meta.kind == "null":
            return self
        dt = self.dtype
        v = dt.store(dt.mul(dt.lit(alpha), dt.work(F.col("v"))))
        return SparseMatrix(self.entries.withColumn("v", v), self.meta.with_(kind="general"))

    def conj(self) -> SparseMatrix:
        return SparseMatrix(self.entries.withColumn("v", self.dtype.conj(F.col("v"))), self.meta)

    def drop_zeros(self) -> SparseMatrix:
        return SparseMatrix(self.entries.where(self.dtype.nonzero(F.col("v"))), self.meta.with_(kind="general" if self.meta.kind != "null" else "null"))

    def convert(self, layout: str, block_size: int = 1) -> SparseMatrix:
        """The layout that exports.tables gives; block_size is for bsr. Entries stay as they are; dense and bsr hold zeros anyway."""
        if layout not in ("coo", "csr", "csc", "dense", "bsr"):
            raise InputParameterError(f"no conversion to {layout!r}", 2)
        if layout == "bsr" and (block_size <= 0 or self.m % block_size or self.n % block_size):
            raise InputParameterError("the block size must divide rows and columns", 3)
        return SparseMatrix(self.entries, self.meta.with_(layout=layout, block_size=block_size if layout == "bsr" else 1))

    def rebase(self, base: int) -> SparseMatrix:
        check_base(base, 2)
        return SparseMatrix(self.entries, self.meta.with_(index_base=base))

    def typed(self, dt: DType) -> SparseMatrix:
        """Null and identity matrices in another value type."""
        if self.dtype == dt or not self.meta.typeless:
            return self
        return identity(self.spark, self.n, dt) if self.meta.kind == "identity" else null(self.spark, self.m, self.n, dt)

    # --- update -------------------------------------------------------------------------------
    def update(self, changes: DataFrame) -> SparseMatrix:
        """changes (i, j, v[, pos]): new values of stored entries; of one entry the change with the largest pos counts.

        An entry out of range or not stored is an input error, and then nothing is changed.
        Indices are in the matrix's index base. The matrix meets the changes once, in a join
        that is kept until destroy() of the result.
        """
        b = self.meta.index_base
        pos = F.col("pos") if "pos" in changes.columns else F.monotonically_increasing_id()
        given = changes.select((F.col("i") - b).cast("long").alias("i"), (F.col("j") - b).cast("long").alias("j"), "v", pos.alias("pos"))
        dt, i, j = self.dtype, F.col("i"), F.col("j")
        new = given.groupBy("i", "j").agg(F.struct(F.max_by("v", "pos").alias("v")).alias("u"))
        both = self.entries.select("i", "j", F.struct("v").alias("s")).join(new, ["i", "j"], "full").persist()
        outside = (i < 0) | (i >= self.m) | (j < 0) | (j >= self.n)
        missing = F.col("u").isNotNull() & F.col("s").isNull()
        wrong = both.where(missing).agg(F.count("*").alias("n"), F.coalesce(F.max(outside), F.lit(False)).alias("outside")).first()
        if wrong["n"]:
            both.unpersist()
            raise InputParameterError("an update out of range" if wrong["outside"] else "an update of an entry that is not stored", 3)
        v = F.when(F.col("u").isNotNull(), dt.store(F.col("u.v"))).otherwise(F.col("s.v"))
        return SparseMatrix(both.select("i", "j", v.alias("v")), self.meta.with_(kind="general"), (both,))


def column(df: DataFrame, name: str = "v") -> Column:
    return df[name]


def null(spark: SparkSession, m: int, n: int, dt: DType | str = "d") -> SparseMatrix:
    """An m x n matrix without entries."""
    check_shape(m, n)
    dt = dtype(dt)
    return SparseMatrix(spark.createDataFrame([], f"i long, j long, v {dt.ddl}"), MatrixMeta(m, n, dt, "null"))


def identity(spark: SparkSession, n: int, dt: DType | str = "d") -> SparseMatrix:
    check_shape(n, n)
    dt = dtype(dt)
    return SparseMatrix(spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), dt.store(dt.lit(1)).alias("v")), MatrixMeta(n, n, dt, "identity"))


def common_dtype(*operands: SparseMatrix, arg_pos: int = 1, error: type = InputParameterError) -> DType:
    """The operands' value type; null and identity matrices take any."""
    kinds = {a.dtype for a in operands if not a.meta.typeless}
    if len(kinds) > 1:
        raise error(f"operands of different value types: {sorted(k.code for k in kinds)}", arg_pos)
    return kinds.pop() if kinds else operands[0].dtype
