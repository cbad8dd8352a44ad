"""Products, sums, norms: joins, unions and aggregates, built without the terms that a zero scalar or an empty operand switches off."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.aggregate import sum_by
from ..plans.meta import InputParameterError, MatrixMeta, Trans, get_reproducibility
from .matrix import SparseMatrix, common_dtype, identity, null

#: Dense vectors of at most so many entries (24 bytes each) are broadcast in products; longer ones are joined by shuffle.
BROADCAST_ENTRIES = 1_000_000


def _general(entries: DataFrame, m: int, n: int, like: SparseMatrix, dt) -> SparseMatrix:
    return SparseMatrix(entries, MatrixMeta(m, n, dt, hints=like.meta.hints))


def _scaled(a: SparseMatrix, alpha, dt) -> DataFrame:
    """Entries in working precision times alpha; alpha = 1 adds no arithmetic."""
    v = dt.work(F.col("v"))
    return a.entries.select("i", "j", (v if alpha == 1 else dt.mul(dt.lit(alpha), v)).alias("v"))


# --- matrix times vector --------------------------------------------------------------------


def spmv(a: SparseMatrix, x: DataFrame | None, alpha=1.0, beta=0.0, y: DataFrame | None = None, trans: Trans | str = "N") -> DataFrame:
    """y <- alpha op(A) x + beta y as (i, v) for every i of the result. beta = 0: y is not read; alpha = 0: neither A nor x."""
    trans = Trans.of(trans, 2)
    dt, op = a.dtype, a.op(trans)
    every = a.spark.range(op.m).withColumnRenamed("id", "i")
    old = None
    if beta != 0:
        if y is None:
            raise InputParameterError("beta is not zero, but there is no y", 6)
        old = y.select("i", dt.mul(dt.lit(beta), dt.work(F.col("v"))).alias("o"))
    product = None
    if alpha != 0 and a.meta.kind != "null" and op.n and op.m:
        if x is None:
            raise InputParameterError("alpha is not zero, but there is no x", 4)
        if a.meta.kind == "identity":
            product = x.select("i", dt.mul(dt.lit(alpha), dt.work(F.col("v"))).alias("p"))
        else:
            right = x.select(F.col("i").alias("j"), dt.work(F.col("v")).alias("x"))
            if op.n <= BROADCAST_ENTRIES:
                right = F.broadcast(right)
            # repeated entries need no sum of their own first; in the reproducible mode their order is that of entries
            rows = op.entries if get_reproducibility() == "reproducible" else op.terms
            terms = rows.select("i", "j", dt.work(F.col("v")).alias("a")).join(right, "j")
            sums = sum_by(terms, ["i"], "j", dt.mul(F.col("a"), F.col("x")), dt)
            product = sums.select("i", (F.col("v") if alpha == 1 else dt.mul(dt.lit(alpha), F.col("v"))).alias("p"))
    if product is not None:
        every = every.join(product, "i", "left")
    if old is not None:
        every = every.join(old, "i", "left")
    parts = [dt.coalesce(F.col(c), dt.zero) for c, df in (("p", product), ("o", old)) if df is not None]
    v = dt.zero if not parts else parts[0] if len(parts) == 1 else dt.add(*parts)
    return every.select("i", dt.store(v).alias("v"))


# --- sums -------------------------------------------------------------------------------------


def spadd(a: SparseMatrix, b: SparseMatrix, alpha=1.0, beta=1.0, trans_a: Trans | str = "N", trans_b: Trans | str = "N", c: SparseMatrix | None = None) -> SparseMatrix:
    """C <- alpha op(A) + beta op(B), C null of that shape (if given). The pattern is the union; sums of zero stay entries. An operand with a zero scalar isn't read."""
    dt = common_dtype(a, b, arg_pos=4)
    x, y = a.typed(dt).op(trans_a), b.typed(dt).op(trans_b)
    if (x.m, x.n) != (y.m, y.n):
        raise InputParameterError(f"{x.m} x {x.n} and {y.m} x {y.n} don't add", 4)
    if c is not None and (c.meta.kind != "null" or (c.m, c.n) != (x.m, x.n)):
        raise InputParameterError("the result must be a null matrix of the operands' shape", 7)
    live = [(s, v) for s, v in ((alpha, x), (beta, y)) if s != 0 and v.meta.kind != "null"]
    if not live:
        return null(a.spark, x.m, x.n, dt)
    if len(live) == 1:
        e = _scaled(live[0][1], live[0][0], dt)
    else:
        e = _scaled(live[0][1], live[0][0], dt).withColumn("o", F.lit(0)).unionByName(_scaled(live[1][1], live[1][0], dt).withColumn("o", F.lit(1)))
        e = sum_by(e, ["i", "j"], "o", F.col("v"), dt)
    return _general(e.select("i", "j", dt.store(F.col("v")).alias("v")), x.m, x.n, a, dt)


def _plus(product: SparseMatrix, beta, c: SparseMatrix | None) -> SparseMatrix:
    if beta == 0:
        return product
    if c is None:
        raise InputParameterError("beta is not zero, but there is no C", 8)
    if (c.m, c.n) != (product.m, product.n):
        raise InputParameterError(f"C is {c.m} x {c.n}, the product {product.m} x {product.n}", 8)
    return spadd(product, c, 1.0, beta)


# --- matrix times matrix -------------------------------------------------------------------------


def spmm(a: SparseMatrix, b: SparseMatrix, alpha=1.0, beta=0.0, c: SparseMatrix | None = None, trans_a: Trans | str = "N", trans_b: Trans | str = "N") -> SparseMatrix:
    """C <- alpha op(A) op(B) + beta C. The pattern is structural: products that cancel stay entries."""
    dt = common_dtype(a, b, *([c] if c is not None and beta != 0 else []), arg_pos=5)
    x, y = a.typed(dt).op(trans_a), b.typed(dt).op(trans_b)
    if x.n != y.m:
        raise InputParameterError(f"{x.m} x {x.n} by {y.m} x {y.n}", 5)
    if alpha == 0 or "null" in (x.meta.kind, y.meta.kind) or not (x.m and x.n and y.n):
        product = null(a.spark, x.m, y.n, dt)
    elif x.meta.kind == y.meta.kind == "identity" and alpha == 1:
        product = identity(a.spark, x.m, dt)
    elif "identity" in (x.meta.kind, y.meta.kind):
        other = y if x.meta.kind == "identity" else x
        product = _general(_scaled(other, alpha, dt).select("i", "j", dt.store(F.col("v")).alias("v")), x.m, y.n, a, dt)
    else:
        left = x.entries.select("i", F.col("j").alias("k"), dt.work(F.col("v")).alias("a"))
        right = y.entries.select(F.col("i").alias("k"), "j", dt.work(F.col("v")).alias("b"))
        # the strategy hint broadcasts the right operand; its bound is the caller's: rows of at most BROADCAST_ENTRIES entries
        if a.meta.hints.get("spmm_strategy") == "broadcast" and y.m * y.n <= BROADCAST_ENTRIES:
            right = F.broadcast(right)
        sums = sum_by(left.join(right, "k"), ["i", "j"], "k", dt.mul(F.col("a"), F.col("b")), dt)
        v = F.col("v") if alpha == 1 else dt.mul(dt.lit(alpha), F.col("v"))
        product = _general(sums.select("i", "j", dt.store(v).alias("v")), x.m, y.n, a, dt)
    return _plus(product, beta, c)


def spmm_pattern(a: SparseMatrix, b: SparseMatrix, trans_a: Trans | str = "N", trans_b: Trans | str = "N") -> DataFrame:
    """The symbolic product: (i, j) of every entry that spmm would give."""
    x, y = a.op(trans_a), b.op(trans_b)
    left, right = x.entries.select("i", F.col("j").alias("k")), y.entries.select(F.col("i").alias("k"), "j")
    return left.join(right, "k").select("i", "j").distinct()


def spelmm(a: SparseMatrix, b: SparseMatrix, alpha=1.0, beta=0.0, c: SparseMatrix | None = None, trans_a: Trans | str = "N", trans_b: Trans | str = "N") -> SparseMatrix:
    """C <- alpha op(A) o op(B) + beta C, entry by entry."""
    dt = common_dtype(a, b, *([c] if c is not None and beta != 0 else []), arg_pos=5)
    x, y = a.typed(dt).op(trans_a), b.typed(dt).op(trans_b)
    if (x.m, x.n) != (y.m, y.n):
        raise InputParameterError(f"{x.m} x {x.n} and {y.m} x {y.n} don't match", 5)
    if alpha == 0 or "null" in (x.meta.kind, y.meta.kind):
        product = null(a.spark, x.m, x.n, dt)
    else:
        both = x.entries.select("i", "j", dt.work(F.col("v")).alias("a")).join(y.entries.select("i", "j", dt.work(F.col("v")).alias("b")), ["i", "j"])
        v = dt.mul(F.col("a"), F.col("b"))
        v = v if alpha == 1 else dt.mul(dt.lit(alpha), v)
        product = _general(both.select("i", "j", dt.store(v).alias("v")), x.m, x.n, a, dt)
    return _plus(product, beta, c)


#: Columns of a dense right operand that one row of a join carries; the sums of many more would not be compiled as one method.
PANEL = 16


def spmm_rows(a: SparseMatrix, rows: DataFrame, n: int, alpha=1.0, trans_a: Trans | str = "N") -> DataFrame:
    """alpha op(A) B for a dense B of n real columns, kept as rows (i, values): the product's rows (i, values), zeros where op(A) has an empty row.

    Rows of B meet the entries of A in panels of PANEL columns, each a column of the join: a
    product's row is summed in so many aggregates, not in one group for each of its cells. A
    dense A comes as from_rows(..., keep_zeros=True).
    """
    dt = a.dtype
    if dt.is_complex:
        raise InputParameterError("dense rows are real", 5)
    op, cols = a.op(trans_a), [f"c{k}" for k in range(min(PANEL, max(n, 1)))]
    wide, panels = len(cols), -(-max(n, 1) // len(cols))
    at = F.explode(F.sequence(F.lit(0), F.lit(panels - 1))).alias("panel")
    b = rows.select(F.col("i").alias("k"), "values", at).select("k", "panel", *[F.get("values", F.col("panel") * wide + k).cast("double").alias(c) for k, c in enumerate(cols)])
    e = op.entries.select("i", F.col("j").alias("k"), dt.work(F.col("v")).alias("a"))
    sums = e.join(b, "k").groupBy("i", "panel").agg(*[F.sum(F.col("a") * F.col(c)).alias(c) for c in cols])
    part = F.struct("panel", F.array(*[F.lit(float(alpha)) * F.col(c) for c in cols]).alias("x"))
    got = sums.groupBy("i").agg(F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["x"])), 1, n).alias("values"))
    zeros = F.array_repeat(F.lit(0.0), n)
    return a.spark.range(op.m).withColumnRenamed("id", "i").join(got, "i", "left").select("i", F.coalesce("values", zeros).alias("values"))


def _dot(u: Column, w: Column) -> Column:
    return F.aggregate(F.zip_with(u, w, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)


def _rows_of(a: SparseMatrix) -> DataFrame:
    """Dense rows (i, values), of which every cell is a row before: for operands that are dense anyway."""
    grid = a.spark.range(a.m).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(a.n - 1).cast("long"))).alias("j"))
    cells = grid.join(a.entries, ["i", "j"], "left").select("i", "j", F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("v"))
    return cells.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda c: c["v"]).alias("values"))


def sddmm(a: SparseMatrix, b: SparseMatrix, c: SparseMatrix, alpha=1.0, beta=0.0, trans_a: Trans | str = "N", trans_b: Trans | str = "N") -> SparseMatrix:
    """C <- alpha (op(A) op(B) at the entries stored in C) + beta C; a null C stays null.

    By joining on the inner index and keeping products at C's entries (each such entry joined
    with the row of A, then the column of B): terms of other entries are never made. Where C
    has the hint sddmm_strategy = "arrays" (for real operands that are mostly stored): a dot
    product of dense rows per entry of C.
    """
    dt = common_dtype(a, b, c, arg_pos=5)
    x, y = a.typed(dt).op(trans_a), b.typed(dt).op(trans_b)
    if not (x.m and x.n and y.n):
        raise InputParameterError("an operand without rows or columns", 3)
    if x.n != y.m or (c.m, c.n) != (x.m, y.n):
        raise InputParameterError(f"{x.m} x {x.n} by {y.m} x {y.n} into {c.m} x {c.n}", 5)
    if c.meta.kind == "null":
        return c
    pattern = c.entries.select("i", "j", dt.work(F.col("v")).alias("c"))
    old = None if beta == 0 else dt.mul(dt.lit(beta), F.col("c"))
    if alpha == 0 or "null" in (x.meta.kind, y.meta.kind):
        v = dt.zero if old is None else old
        return _general(pattern.select("i", "j", dt.store(v).alias("v")), c.m, c.n, c, dt)
    if c.meta.hints.get("sddmm_strategy") == "arrays" and not dt.is_complex:
        return sddmm_rows(_rows_of(x), _rows_of(y.op("T")).withColumnRenamed("i", "j"), c, alpha, beta)
    left = x.entries.select("i", F.col("j").alias("k"), dt.work(F.col("v")).alias("a"))
    right = y.entries.select(F.col("i").alias("k"), "j", dt.work(F.col("v")).alias("b"))
    terms = pattern.select("i", "j").join(left, "i").join(right, ["k", "j"])
    sums = sum_by(terms, ["i", "j"], "k", dt.mul(F.col("a"), F.col("b")), dt).withColumnRenamed("v", "s")
    s = dt.mul(dt.lit(alpha), dt.coalesce(F.col("s"), dt.zero))
    out = pattern.join(sums, ["i", "j"], "left").select("i", "j", dt.store(s if old is None else dt.add(s, old)).alias("v"))
    return _general(out, c.m, c.n, c, dt)


def sddmm_rows(rows_a: DataFrame, rows_b: DataFrame, c: SparseMatrix, alpha=1.0, beta=0.0) -> SparseMatrix:
    """sddmm of dense real operands kept as rows: A as (i, values), the columns of B as (j, values); a dot product of arrays per entry of C."""
    dt = c.dtype
    if dt.is_complex:
        raise InputParameterError("dense rows are real", 5)
    both = c.entries.join(rows_a.select("i", F.col("values").alias("u")), "i").join(rows_b.select("j", F.col("values").alias("w")), "j")
    as_double = lambda x: F.transform(x, lambda e: e.cast("double"))
    v = F.lit(float(alpha)) * _dot(as_double(F.col("u")), as_double(F.col("w")))
    if beta != 0:
        v = v + F.lit(float(beta)) * F.col("v").cast("double")
    return _general(both.select("i", "j", dt.store(v).alias("v")), c.m, c.n, c, dt)


# --- norms -------------------------------------------------------------------------------------------

#: Squares of numbers outside (SMALL, LARGE) leave the range of doubles or lose digits; they are summed scaled.
_SMALL, _LARGE, _UP, _DOWN = 2.0**-511, 2.0**486, 2.0**537, 2.0**-538


def norm_inf(a: SparseMatrix) -> float:
    """The largest sum of a row's absolute values; NaN if one is NaN; 0 without entries."""
    if a.meta.kind == "identity":
        return 1.0 if a.n else 0.0
    sums = sum_by(a.entries, ["i"], "j", a.dtype.abs(F.col("v")), _REAL)
    return sums.agg(F.coalesce(F.max("v"), F.lit(0.0))).first()[0]


def norm_frobenius(a: SparseMatrix) -> float:
    """The root of the sum of squares, in three ranges so that it neither overflows nor underflows before the result does."""
    if a.meta.kind == "identity":
        return math.sqrt(a.n)
    parts = a.entries.select(F.explode(F.array(*a.dtype.parts(F.col("v")))).alias("x")).select(F.abs("x").alias("x"))
    x = F.col("x")
    small, large = x < _SMALL, x > _LARGE
    sq = lambda scale: (x * F.lit(scale)) * (x * F.lit(scale))
    lo, mid, hi = parts.agg(
        F.coalesce(F.sum(F.when(small, sq(_UP))), F.lit(0.0)), F.coalesce(F.sum(F.when(~small & (~large | F.isnan(x)), x * x)), F.lit(0.0)), F.coalesce(F.sum(F.when(large & ~F.isnan(x), sq(_DOWN))), F.lit(0.0))
    ).first()
    if hi > 0:
        return math.sqrt(hi + (mid * _DOWN) * _DOWN) / _DOWN
    if math.isnan(mid) or mid > 0:
        return math.sqrt(mid + (lo / _UP) / _UP)
    return math.sqrt(lo) / _UP


def spnorm(a: SparseMatrix, kind: str | int) -> float:
    if kind in ("inf", 1001):
        return norm_inf(a)
    if kind in ("frobenius", 1002):
        return norm_frobenius(a)
    raise InputParameterError(f"a norm is inf or frobenius, not {kind!r}", 2)


from ..functions.scalars import DTYPES  # noqa: E402

_REAL = DTYPES["d"]
