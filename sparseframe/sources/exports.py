"""Matrices as tables and arrays of the usual layouts. Tables stay distributed; the `*_arrays` forms bring small ones to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.matrix import SparseMatrix
from ..plans.aggregate import prefix_sums
from ..plans.meta import InputParameterError, check_base


def _ready(a: SparseMatrix, base: int | None) -> int:
    if a.m <= 0 or a.n <= 0:
        raise InputParameterError("nothing to export of an empty shape", 1)
    base = a.meta.index_base if base is None else base
    check_base(base, 2)
    return base


def csr(a: SparseMatrix, base: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(i, ptr) with m + 1 rows, and (pos, j, v) in row order with columns ascending."""
    b = _ready(a, base)
    ptr = prefix_sums(a.entries.groupBy("i").agg(F.count("*").alias("c")), a.m)
    at = F.row_number().over(Window.partitionBy("i").orderBy("j")) - 1
    ranked = a.entries.withColumn("r", at).join(ptr, "i")
    entries = ranked.select((F.col("ptr") + F.col("r")).alias("pos"), (F.col("j") + b).alias("j"), "v")
    return ptr.select("i", (F.col("ptr") + b).alias("ptr")), entries


def csc(a: SparseMatrix, base: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(j, ptr) with n + 1 rows, and (pos, i, v) in column order with rows ascending."""
    ptr, entries = csr(a.op("T"), base)
    return ptr.withColumnRenamed("i", "j"), entries.withColumnRenamed("j", "i")


def coo(a: SparseMatrix) -> DataFrame:
    """(i, j, v) in the matrix's index base, ordered."""
    b = _ready(a, None)
    return a.entries.select((F.col("i") + b).alias("i"), (F.col("j") + b).alias("j"), "v").orderBy("i", "j")


def dense(a: SparseMatrix, layout: str = "row") -> DataFrame:
    """(pos, v) of all m * n values, tightly by rows or columns."""
    _ready(a, None)
    if layout not in ("row", "col"):
        raise InputParameterError(f"a layout is row or col, not {layout!r}", 2)
    major, minor, size, inner = ("i", "j", a.m, a.n) if layout == "row" else ("j", "i", a.n, a.m)
    grid = a.spark.range(size).select(F.col("id").alias(major), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(inner - 1).cast("long"))).alias(minor))
    dt = a.dtype
    v = F.when(F.col("v").isNull(), dt.store(dt.zero)).otherwise(F.col("v"))
    return grid.join(a.entries, ["i", "j"], "left").select((F.col(major) * inner + F.col(minor)).alias("pos"), v.alias("v"))


def blocks(a: SparseMatrix, block_size: int | None = None, layout: str = "row", base: int | None = None) -> DataFrame:
    """(bi, bj, values) of the blocks that hold an entry, padded with zeros; block_size: the matrix's own unless given."""
    shown = _ready(a, base)
    block_size = a.meta.block_size if block_size is None else block_size
    if layout not in ("row", "col"):
        raise InputParameterError(f"a layout is row or col, not {layout!r}", 3)
    b, dt = block_size, a.dtype
    if b <= 0 or a.m % b or a.n % b:
        raise InputParameterError("the block size must divide rows and columns", 2)
    r, c = F.col("i") % b, F.col("j") % b
    p = (r * b + c if layout == "row" else c * b + r).cast("int")
    cells = a.entries.groupBy(F.floor(F.col("i") / b).alias("bi"), F.floor(F.col("j") / b).alias("bj")).agg(F.map_from_entries(F.collect_list(F.struct(p.alias("p"), F.col("v").alias("v")))).alias("c"))
    zero = dt.store(dt.zero)
    values = F.transform(F.sequence(F.lit(0), F.lit(b * b - 1)), lambda k: F.coalesce(F.col("c")[k], zero))
    return cells.select((F.col("bi") + shown).alias("bi"), (F.col("bj") + shown).alias("bj"), values.alias("values"))


def bsr(a: SparseMatrix, block_size: int | None = None, layout: str = "row", base: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(i, ptr) of block rows, and (pos, j, values) of the blocks in order; block_size: the matrix's own unless given."""
    b = _ready(a, base)
    block_size = a.meta.block_size if block_size is None else block_size
    cells = blocks(a, block_size, layout, 0)
    ptr = prefix_sums(cells.groupBy(F.col("bi").alias("i")).agg(F.count("*").alias("c")), a.m // block_size)
    at = F.row_number().over(Window.partitionBy("bi").orderBy("bj")) - 1
    entries = cells.withColumn("r", at).join(ptr, cells["bi"] == ptr["i"]).select((F.col("ptr") + F.col("r")).alias("pos"), (F.col("bj") + b).alias("j"), "values")
    return ptr.select("i", (F.col("ptr") + b).alias("ptr")), entries


def tables(a: SparseMatrix, base: int | None = None) -> tuple[DataFrame, ...]:
    """The matrix's tables in the layout that it was made in or converted to (supernodes: as compressed rows)."""
    make = {"coo": lambda: (coo(a),), "csr": lambda: csr(a, base), "csc": lambda: csc(a, base), "dense": lambda: (dense(a),), "bsr": lambda: bsr(a, base=base), "supernodal": lambda: csr(a, base)}
    return make[a.meta.layout]()


def _plain(v):
    return complex(v["re"], v["im"]) if hasattr(v, "asDict") else v


def csr_arrays(a: SparseMatrix, base: int | None = None) -> tuple[list[int], list[int], list]:
    ptr, entries = csr(a, base)
    e = entries.orderBy("pos").collect()
    return [r["ptr"] for r in ptr.orderBy("i").collect()], [r["j"] for r in e], [_plain(r["v"]) for r in e]


def csc_arrays(a: SparseMatrix, base: int | None = None) -> tuple[list[int], list[int], list]:
    """row_indx, col_ptr, vals."""
    ptr, entries = csc(a, base)
    e = entries.orderBy("pos").collect()
    return [r["i"] for r in e], [r["ptr"] for r in ptr.orderBy("j").collect()], [_plain(r["v"]) for r in e]


def dense_array(a: SparseMatrix, layout: str = "row") -> list:
    return [_plain(r["v"]) for r in dense(a, layout).orderBy("pos").collect()]


def bsr_arrays(a: SparseMatrix, block_size: int | None = None, layout: str = "row", base: int | None = None) -> tuple[list[int], list[int], list]:
    ptr, entries = bsr(a, block_size, layout, base)
    e = entries.orderBy("pos").collect()
    return [r["ptr"] for r in ptr.orderBy("i").collect()], [r["j"] for r in e], [_plain(v) for r in e for v in r["values"]]
