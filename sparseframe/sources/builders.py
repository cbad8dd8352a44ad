"""Matrices from the usual layouts. Arrays may be Python sequences or array columns of a one-row DataFrame's worth of data; tables stay distributed."""

from __future__ import annotations

from collections.abc import Sequence
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import DType, dtype
from ..operators.matrix import SparseMatrix
from ..plans.meta import ExecutionFailure, InputParameterError, MatrixMeta, check_base, check_shape


def _values(dt: DType, vals: Sequence) -> list:
    if dt.is_complex:
        return [(complex(v).real, complex(v).imag) for v in vals]
    return [float(v) for v in vals]


def values_frame(spark: SparkSession, dt: DType, vals: Sequence, **indices: Sequence[int]) -> DataFrame:
    rows = list(zip(*[[int(x) for x in xs] for xs in indices.values()], _values(dt, vals), strict=True))
    return spark.createDataFrame(rows, ", ".join([f"{n} long" for n in indices] + [f"v {dt.ddl}"]))


def from_table(entries: DataFrame, m: int, n: int, dt: DType | str = "d", i: str = "i", j: str = "j", v: str = "v", index_base: int = 0, duplicates: str = "sum", no_copy: bool = False) -> SparseMatrix:
    """Triplets of any table. duplicates: "sum" adds values of one (i, j), "error" rejects them, "unique" takes the caller's word that there are none."""
    check_shape(m, n)
    check_base(index_base)
    dt = dtype(dt)
    rows = entries.select((F.col(i) - index_base).cast("long").alias("i"), (F.col(j) - index_base).cast("long").alias("j"), dt.work(F.col(v)).alias("v"))
    terms = None
    if duplicates == "sum":
        if dt.code in "dz":  # single precision rounds the sums
            terms = rows
        rows = rows.groupBy("i", "j").agg(dt.sum(F.col("v")).alias("v"))
    elif duplicates == "error":
        if rows.groupBy("i", "j").count().where("count > 1").limit(1).count():
            raise InputParameterError("two values for one entry", 5)
    elif duplicates != "unique":
        raise InputParameterError(f"duplicates: sum, error or unique, not {duplicates!r}", 9)
    return SparseMatrix(rows.select("i", "j", dt.store(F.col("v")).alias("v")), MatrixMeta(m, n, dt, index_base=index_base, no_copy=no_copy), terms=terms)


def from_coo(spark: SparkSession, m: int, n: int, row_indx: Sequence[int], col_indx: Sequence[int], vals: Sequence, dt: DType | str = "d", duplicates: str = "sum", no_copy: bool = False) -> SparseMatrix:
    """Triplets, 0-based."""
    check_shape(m, n)
    return from_table(values_frame(spark, dtype(dt), vals, i=row_indx, j=col_indx), m, n, dt, duplicates=duplicates, no_copy=no_copy)


def _pointers(ptr: Sequence[int], size: int, what: int) -> int:
    if len(ptr) != size + 1:
        raise InputParameterError(f"{size + 1} pointers are needed, not {len(ptr)}", what)
    check_base(ptr[0], what)
    if any(a > b for a, b in zip(ptr, ptr[1:], strict=False)):
        raise InputParameterError("pointers must not fall", what)
    return ptr[0]


def _expand(ptr: Sequence[int]) -> list[int]:
    return [r for r, (a, b) in enumerate(zip(ptr, ptr[1:], strict=False)) for _ in range(b - a)]


def from_csr(spark: SparkSession, m: int, n: int, row_ptr: Sequence[int], col_indx: Sequence[int], vals: Sequence, dt: DType | str = "d", no_copy: bool = False) -> SparseMatrix:
    """Compressed rows; row_ptr[0] is the index base. Columns need no order; zeros are kept."""
    check_shape(m, n)
    base = _pointers(row_ptr, m, 4)
    nnz = row_ptr[-1] - base
    a = from_coo(spark, m, n, _expand(row_ptr), [c - base for c in col_indx[:nnz]], vals[:nnz], dt, no_copy=no_copy)
    return SparseMatrix(a.entries, a.meta.with_(index_base=base, layout="csr"))


def from_csc(spark: SparkSession, m: int, n: int, row_indx: Sequence[int], col_ptr: Sequence[int], vals: Sequence, dt: DType | str = "d", no_copy: bool = False) -> SparseMatrix:
    check_shape(m, n)
    base = _pointers(col_ptr, n, 5)
    nnz = col_ptr[-1] - base
    a = from_coo(spark, m, n, [r - base for r in row_indx[:nnz]], _expand(col_ptr), vals[:nnz], dt, no_copy=no_copy)
    return SparseMatrix(a.entries, a.meta.with_(index_base=base, layout="csc"))


def from_csr_tables(row_ptr: DataFrame, entries: DataFrame, m: int, n: int, dt: DType | str = "d", index_base: int = 0) -> SparseMatrix:
    """Compressed rows as tables (i, ptr) and (pos, j, v): each row's range of positions meets them by chunks of positions."""
    check_shape(m, n)
    dt, size = dtype(dt), 1 << 16
    ranges = row_ptr.select("i", (F.col("ptr") - index_base).alias("lo"), (F.lead("ptr").over(Window.partitionBy(F.floor((F.col("i") + 0) / size)).orderBy("i")) - index_base).alias("hi"))
    # the last row of a chunk of rows has its end in the next chunk
    nxt = row_ptr.select((F.col("i") - 1).alias("i"), (F.col("ptr") - index_base).alias("end"))
    ranges = ranges.join(nxt, "i").select("i", "lo", F.coalesce("hi", "end").alias("hi")).where("hi > lo")
    # a long row is dealt out by chunks of its positions before they are listed
    cut = ranges.select("i", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor((F.col("hi") - 1) / size))).alias("b")).repartition("b")
    wide = cut.select("i", F.explode(F.sequence(F.greatest("lo", F.col("b") * size), F.least("hi", (F.col("b") + 1) * size) - 1)).alias("pos"))
    # the plan takes listed positions for as few as the ranges they come from: they must not be broadcast
    rows = wide.hint("merge").join(entries.select("pos", (F.col("j") - index_base).alias("j"), "v"), "pos")
    return from_table(rows, m, n, dt)


def from_csc_tables(col_ptr: DataFrame, entries: DataFrame, m: int, n: int, dt: DType | str = "d", index_base: int = 0) -> SparseMatrix:
    """Compressed columns as tables (j, ptr) and (pos, i, v)."""
    rows = from_csr_tables(col_ptr.withColumnRenamed("j", "i"), entries.withColumnRenamed("i", "j"), n, m, dt, index_base).op("T")
    return SparseMatrix(rows.entries, rows.meta.with_(layout="csc"))


def from_dense(spark: SparkSession, m: int, n: int, vals: Sequence, layout: str = "row", lda: int | None = None, dt: DType | str = "d", keep_zeros: bool = False, no_copy: bool = False) -> SparseMatrix:
    """A dense array by rows ("row") or columns ("col") with leading dimension lda. Zeros are left out unless asked for."""
    check_shape(m, n)
    dt = dtype(dt)
    if layout not in ("row", "col"):
        raise InputParameterError(f"a layout is row or col, not {layout!r}", 6)
    least = n if layout == "row" else m
    lda = least if lda is None else lda
    if lda < least:
        raise InputParameterError("the leading dimension is too small", 7)
    at = [(r, c, r * lda + c if layout == "row" else c * lda + r) for r in range(m) for c in range(n)]
    a = from_coo(spark, m, n, [r for r, _, _ in at], [c for _, c, _ in at], [vals[p] for _, _, p in at], dt, "unique", no_copy)
    a = SparseMatrix(a.entries, a.meta.with_(layout="dense"))
    return a if keep_zeros else a.drop_zeros()


def from_rows(rows: DataFrame, m: int, n: int, i: str = "i", values: str = "values", dt: DType | str = "d", keep_zeros: bool = False) -> SparseMatrix:
    """Dense rows (i, array of n values) of a table."""
    check_shape(m, n)
    dt = dtype(dt)
    e = rows.select(F.col(i).cast("long").alias("i"), F.posexplode(values).alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), dt.store(F.col("v")).alias("v"))
    a = SparseMatrix(e, MatrixMeta(m, n, dt, layout="dense"))
    return a if keep_zeros else a.drop_zeros()


def from_blocks(blocks: DataFrame, m: int, n: int, block_size: int, layout: str = "row", dt: DType | str = "d", keep_zeros: bool = False, index_base: int = 0) -> SparseMatrix:
    """Square blocks (bi, bj, values: array of block_size**2) of a table; padding zeros go unless kept."""
    check_shape(m, n)
    if block_size <= 0 or m % block_size or n % block_size:
        raise InputParameterError("the block size must divide rows and columns", 4)
    if layout not in ("row", "col"):
        raise InputParameterError(f"a layout is row or col, not {layout!r}", 5)
    dt, b = dtype(dt), block_size
    p = blocks.select((F.col("bi") - index_base).alias("bi"), (F.col("bj") - index_base).alias("bj"), F.posexplode("values").alias("p", "v"))
    major, minor = F.floor(F.col("p") / b), F.col("p") % b
    r, c = (major, minor) if layout == "row" else (minor, major)
    e = p.select((F.col("bi") * b + r).cast("long").alias("i"), (F.col("bj") * b + c).cast("long").alias("j"), dt.store(F.col("v")).alias("v"))
    a = SparseMatrix(e, MatrixMeta(m, n, dt, layout="bsr", index_base=index_base, block_size=block_size))
    return a if keep_zeros else a.drop_zeros()


def from_bsr(spark: SparkSession, m: int, n: int, row_ptr: Sequence[int], col_indx: Sequence[int], vals: Sequence, block_size: int, layout: str = "row", dt: DType | str = "d", keep_zeros: bool = False) -> SparseMatrix:
    check_shape(m, n)
    if block_size <= 0 or m % block_size or n % block_size:
        raise InputParameterError("the block size must divide rows and columns", 7)
    base, dt, size = _pointers(row_ptr, m // block_size, 4), dtype(dt), block_size**2
    nb = row_ptr[-1] - base
    rows = [(bi, int(bj), _values(dt, vals[k * size : (k + 1) * size])) for k, (bi, bj) in enumerate(zip(_expand(row_ptr), [c - base for c in col_indx[:nb]], strict=True))]
    a = from_blocks(spark.createDataFrame(rows, f"bi long, bj long, values array<{dt.ddl}>"), m, n, block_size, layout, dt, keep_zeros)
    return SparseMatrix(a.entries, a.meta.with_(index_base=base))


def read_matrix_market(spark: SparkSession, path: str, triangle: str | None = None, dt: DType | str = "d") -> SparseMatrix:
    """A coordinate file: real, integer or pattern (ones); general, symmetric, hermitian or skew-symmetric (mirrored). triangle: only "lower" or "upper" entries."""
    # in the order of the file's parts, of their blocks, and of the lines in a block
    place = F.struct(F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("n"))
    lines = spark.read.text(path).select(F.trim("value").alias("value"), place.alias("at"))
    head = lines.where(F.lower("value").startswith("%%matrixmarket")).select("value").first()
    if head is None:
        raise InputParameterError("no MatrixMarket header", 2)
    _, what, form, field, symmetry = head["value"].lower().split()
    if what != "matrix" or form != "coordinate" or field not in ("real", "integer", "pattern") or symmetry not in ("general", "symmetric", "hermitian", "skew-symmetric"):
        raise InputParameterError(f"not served: {head['value']}", 2)
    body = lines.where((F.col("value") != "") & ~F.col("value").startswith("%"))
    size = body.orderBy("at").select("at", "value").first()
    if size is None:
        raise InputParameterError("no size line", 2)
    m, n, _ = map(int, size["value"].split())
    t = F.split("value", r"\s+")
    dt = dtype(dt)
    v = F.lit(1.0) if field == "pattern" else F.get(t, 2).cast("double")
    e = body.where((F.col("at.f") != size["at"]["f"]) | (F.col("at.n") != size["at"]["n"])).select((F.get(t, 0).cast("long") - 1).alias("i"), (F.get(t, 1).cast("long") - 1).alias("j"), v.alias("v"))
    if symmetry != "general":
        sign = -1.0 if symmetry == "skew-symmetric" else 1.0
        e = e.unionByName(e.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), (F.lit(sign) * F.col("v")).alias("v")))
    if triangle == "lower":
        e = e.where("i >= j")
    elif triangle == "upper":
        e = e.where("i <= j")
    elif triangle is not None:
        raise InputParameterError("triangle: lower or upper", 3)
    if dt.is_complex:
        e = e.withColumn("v", F.struct(F.col("v").alias("re"), F.lit(0.0).alias("im")))
    return from_table(e, m, n, dt)


def write_matrix_market(a: SparseMatrix, path: str) -> None:
    """A general real coordinate file, as a folder of text parts of which the first has the header."""
    nnz = a.entries.count()
    head = a.spark.createDataFrame([(-1, "%%MatrixMarket matrix coordinate real general"), (0, f"{a.m} {a.n} {nnz}")], "o long, value string").coalesce(1)
    lines = a.entries.select(F.lit(1).cast("long").alias("o"), F.concat_ws(" ", F.col("i") + 1, F.col("j") + 1, F.col("v").cast("double")).alias("value"))
    head.orderBy("o").select("value").coalesce(1).union(lines.select("value")).write.mode("overwrite").text(path)


def from_supernodes(supernodes: DataFrame, rows: DataFrame, values: DataFrame, m: int, n: int, dt: DType | str = "d") -> tuple[SparseMatrix, DataFrame]:
    """A triangular matrix in supernodes, of tables: supernodes (s, first, last, part), their columns' range and the part
    they belong to; rows (s, p, i), the list of rows that a supernode's columns share; values (j, p, v) of column j at
    place p of its list. Zeros, and places without a value, are padding. Gives the matrix and (i, part) for every row."""
    check_shape(m, n)
    dt = dtype(dt)
    columns = supernodes.select("s", "part", F.explode(F.sequence("first", "last")).alias("j"))
    cells = values.select("j", "p", "v").join(columns.select("s", "j"), "j").join(rows.select("s", "p", "i"), ["s", "p"])
    a = from_table(cells, m, n, dt, duplicates="unique").drop_zeros()
    return SparseMatrix(a.entries, a.meta.with_(layout="supernodal")), columns.select(F.col("j").alias("i"), "part")


def from_supernodal(
    spark: SparkSession, m: int, n: int, nsuper: int, nparts: int, super_row_ptr: Sequence[int], super_col_indx: Sequence[int], row_indx: Sequence[int], col_ptr: Sequence[int], vals: Sequence, part_indx: Sequence[int], dt: DType | str = "d", no_copy: bool = False
) -> tuple[SparseMatrix, DataFrame, int]:
    """A triangular matrix in supernodes: runs of columns (super_col_indx) that share a list of rows (row_indx between super_row_ptr).

    part_indx holds the first and last supernode of each part; the separator's pair comes last
    for a lower, first for an upper matrix. Gives the matrix, (i, part) for every row, and the
    separator's part number. Zeros are padding and go.
    """
    check_shape(m, n)
    if nsuper < 0:
        raise InputParameterError("a negative number of supernodes", 4)
    if no_copy:
        raise InputParameterError("supernodes are always copied", 12)
    if nparts > m or nparts > nsuper:
        raise InputParameterError("a part needs a row and a supernode", 5)
    base = super_row_ptr[0]
    check_base(base, 6)
    if {super_col_indx[0], col_ptr[0]} != {base}:
        raise InputParameterError("index bases differ", 7)
    rows, cols, values = [], [], []
    for s in range(nsuper):
        own = [r - base for r in row_indx[super_row_ptr[s] - base : super_row_ptr[s + 1] - base]]
        for c in range(super_col_indx[s] - base, super_col_indx[s + 1] - base):
            at = col_ptr[c] - base
            if col_ptr[c + 1] - col_ptr[c] != len(own):
                raise InputParameterError("a column's values don't match its supernode's rows", 9)
            rows += own
            cols += [c] * len(own)
            values += vals[at : at + len(own)]
    below = any(r >= super_col_indx[s + 1] - base for s in range(nsuper) for r in [x - base for x in row_indx[super_row_ptr[s] - base : super_row_ptr[s + 1] - base]])
    above = any(r < super_col_indx[s] - base for s in range(nsuper) for r in [x - base for x in row_indx[super_row_ptr[s] - base : super_row_ptr[s + 1] - base]])
    if below == above:
        raise ExecutionFailure("neither clearly lower nor clearly upper triangular", 1)
    a = from_coo(spark, m, n, rows, cols, values, dt).drop_zeros()
    own_part = []
    for p in range(nparts + 1):
        first, last = part_indx[2 * p] - base, part_indx[2 * p + 1] - base
        own_part += [(i, p) for i in range(super_col_indx[first] - base, super_col_indx[last + 1] - base)]
    parts = spark.createDataFrame(own_part, "i long, part int")
    return SparseMatrix(a.entries, a.meta.with_(index_base=base, layout="supernodal")), parts, nparts if below else 0
