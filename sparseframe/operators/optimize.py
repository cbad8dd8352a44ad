"""Preparation before repeated calls: checks what a call would check, and keeps what calls share.

Nothing here changes results. Where the matrix's hints say that an operation runs many times
its entries are dealt by the join key and kept until destroy(); a symbolic result is a kept
table until unpersist(); a prepared solve keeps tables in the shared folder until destroy().
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.meta import InputParameterError, Trans
from . import products, solve
from .matrix import SparseMatrix, common_dtype
from .solve import PreparedSolve

__all__ = ["PreparedSolve", "sddmm_optimize", "spadd_optimize", "spelmm_optimize", "spmm_optimize", "spmv_optimize", "spsm_optimize", "spsv_optimize"]

#: The masked product works on dense rows where more than this share of the mask is stored.
DENSE_SHARE = 0.25


def spmv_optimize(a: SparseMatrix) -> SparseMatrix:
    return a.optimize("spmv")


def spmm_optimize(a: SparseMatrix, b: SparseMatrix, trans_a: Trans | str = "N", trans_b: Trans | str = "N") -> DataFrame:
    """The product's pattern (i, j), kept: its count sizes the result, its rows can pre-filter masks."""
    common_dtype(a, b, arg_pos=4)
    x, y = a.op(trans_a), b.op(trans_b)
    if x.n != y.m:
        raise InputParameterError(f"{x.m} x {x.n} by {y.m} x {y.n}", 4)
    return products.spmm_pattern(a, b, trans_a, trans_b).persist()


def spadd_optimize(a: SparseMatrix, b: SparseMatrix, trans_a: Trans | str = "N", trans_b: Trans | str = "N") -> None:
    """Checks alone: sums need no preparation."""
    common_dtype(a, b, arg_pos=4)
    x, y = a.op(trans_a), b.op(trans_b)
    if (x.m, x.n) != (y.m, y.n):
        raise InputParameterError(f"{x.m} x {x.n} and {y.m} x {y.n} don't match", 4)


spelmm_optimize = spadd_optimize


def sddmm_optimize(a: SparseMatrix, b: SparseMatrix, c: SparseMatrix, trans_a: Trans | str = "N", trans_b: Trans | str = "N") -> SparseMatrix:
    """C with the hint that sddmm obeys: dense rows for a real mask that is mostly stored, else joins. A strategy set by the caller stays."""
    dt = common_dtype(a, b, c, arg_pos=5)
    x, y = a.op(trans_a), b.op(trans_b)
    if x.n != y.m or (c.m, c.n) != (x.m, y.n) or not (x.m and x.n and y.n):
        raise InputParameterError(f"{x.m} x {x.n} by {y.m} x {y.n} into {c.m} x {c.n}", 5)
    if c.meta.hints.get("sddmm_strategy", "unset") != "unset":
        return c
    dense = not dt.is_complex and c.query()["nnz"] > DENSE_SHARE * c.m * c.n
    return c.hint("sddmm_strategy", "arrays" if dense else "join")


def spsv_optimize(a: SparseMatrix, method: str = "auto") -> PreparedSolve:
    """Checks that the matrix can be solved, finds the way to do so, and does what every solve with it needs: for spsv and spsm."""
    return solve.prepare(a, method=method)


spsm_optimize = spsv_optimize
