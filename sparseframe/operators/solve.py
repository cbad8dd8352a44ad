"""Triangular solves op(A) X = alpha Y for one and for many right-hand sides.

Three ways, chosen by ``method`` or by the matrix's hint ``spsv_strategy``:

* ``fold``: the matrix is sent to the tasks, and each substitutes for a panel of right-hand
  sides at a time; up to FOLD_ROWS rows and FOLD_ENTRIES entries, any pattern.
* ``levels``: rows by the length of their longest chain of dependencies; one join and
  aggregate for each level. For matrices of any size with few levels.
* ``blocks``: consecutive ranges of rows; a range is solved by itself after a product with
  what is solved, and ranges that don't depend on each other are solved together. For
  matrices of any size with long chains.

``auto`` takes fold where the matrix is small enough, then levels, then blocks where there
are more than MAX_LEVELS levels. ``prepare`` does once what depends on the matrix alone: its
entries are written by level, so that every solve reads each of them once; solutions are
written level by level, and a level reads those it may depend on. Right-hand sides go in
panels: columns of one table, so that an entry of the matrix meets a panel, not a side.
"""

from __future__ import annotations

from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import DType
from ..plans.meta import Diag, ExecutionFailure, InputParameterError, Shape, Trans
from ..plans.shared import Scratch, by_size
from .matrix import SparseMatrix

FOLD_ROWS, FOLD_ENTRIES, MAX_LEVELS, BLOCK_ROWS = 4096, 1_000_000, 64, 2048
#: Right-hand sides in a panel; pairs of dependent blocks that the driver orders (beyond, blocks go one by one).
PANEL, MAX_PAIRS = 16, 2_000_000


def _checked(a: SparseMatrix, trans: Trans | str) -> tuple[SparseMatrix, bool]:
    """op(A), and whether it is lower."""
    trans = Trans.of(trans, 2)
    if a.meta.kind == "null":
        raise InputParameterError("a null matrix can't be solved", 1)
    if a.meta.kind == "identity":
        return a, True
    shape, diag = a.structure()
    if shape is Shape.RECTANGULAR:
        raise InputParameterError("the matrix is not triangular", 1)
    if diag is Diag.ZERO:
        raise InputParameterError("a zero on the diagonal", 1)
    return a.op(trans), (shape is Shape.LOWER) == (trans is Trans.N)


def _peeled(op: SparseMatrix, limit: int | None) -> DataFrame:
    tmp = Scratch(op.spark)
    edges = tmp.cut(op.entries.where("i <> j").select("i", "j"), "edges")
    left = tmp.cut(edges.groupBy("i").agg(F.count("*").alias("open")), "open-0")
    known = op.spark.range(op.m).withColumnRenamed("id", "i").join(by_size(left.select("i"), op.m), "i", "left_anti").withColumn("level", F.lit(0))
    done = ready = tmp.cut(known, "level-0")
    k, found = 0, ready.count()
    while True:
        solved = edges.join(by_size(ready.select(F.col("i").alias("j")), found), "j").groupBy("i").agg(F.count("*").alias("got"))
        k += 1
        after = tmp.cut(left.join(solved, "i", "left").select("i", (F.col("open") - F.coalesce("got", F.lit(0))).alias("open")), f"open-{k}")
        tmp.drop(f"open-{k - 1}")
        ready, left = tmp.cut(after.where("open = 0").select("i", F.lit(k).alias("level")), f"level-{k}"), after.where("open > 0")
        found = ready.count()
        if not found:
            tmp.drop("edges")
            return done
        done = done.unionByName(ready)
        if limit is not None and k >= limit:
            tmp.drop("edges")
            raise ExecutionFailure(f"more than {limit} levels", 1)


def levels(a: SparseMatrix, trans: Trans | str = "N", limit: int | None = None) -> DataFrame:
    """(i, level): 0 for rows that depend on none, else one more than the largest level they depend on.

    Rows are peeled level by level, each a join and an aggregate; stops with an
    ExecutionFailure beyond `limit` levels.
    """
    return _peeled(_checked(a, trans)[0], limit)


class PreparedSolve(NamedTuple):
    """What a solve needs of its matrix, made once. Its tables stay in the shared folder until destroy()."""

    matrix: SparseMatrix
    trans: Trans
    op: SparseMatrix
    lower: bool
    method: str  # identity, fold, levels or blocks
    tmp: Scratch
    entries: object = None  # fold: arrays sent to the tasks; else a table by level
    rows: DataFrame | None = None  # levels: (i, d, level)
    needs: tuple[tuple[int, ...], ...] = ()  # of each level: the levels whose solutions it reads
    sizes: tuple[int, ...] = ()  # of each level: its rows at most
    block_rows: int = 0
    of_block: object = None  # blocks: (g, level), or None where a block is its own level

    def destroy(self) -> None:
        self.tmp.drop("")
        if self.method == "fold":
            self.entries.unpersist()


def _order(op: SparseMatrix, lower: bool):
    """A column of rows or columns in solving order."""
    return lambda c: F.col(c) if lower else F.lit(op.m - 1) - F.col(c)


def _parts(v: Column, dt: DType) -> tuple[Column, Column]:
    return (v["re"], v["im"]) if dt.is_complex else (v, F.lit(0.0))


def _small(op: SparseMatrix, forced: bool) -> bool:
    """Whether the whole matrix may be sent to the tasks."""
    n = op.entries.count() if op.m <= FOLD_ROWS else None
    fits = n is not None and n <= FOLD_ENTRIES
    if forced and not fits:
        raise ExecutionFailure(f"fold takes {FOLD_ROWS} rows and {FOLD_ENTRIES} entries at most", 1)
    return fits


def prepare(a: SparseMatrix, trans: Trans | str | None = None, method: str = "auto", block_rows: int = BLOCK_ROWS) -> PreparedSolve:
    """Checks the matrix and prepares solves with op(A); trans: the hint spsv_operation unless given."""
    if method not in ("auto", "fold", "levels", "blocks"):
        raise InputParameterError(f"method: auto, fold, levels or blocks, not {method!r}", 5)
    trans = Trans.of(a.meta.hints.get("spsv_operation", Trans.N) if trans is None else trans, 2)
    hint = a.meta.hints.get("spsv_strategy", "unset")
    method = hint if method == "auto" and hint != "unset" else method
    op, lower = _checked(a, trans)
    tmp, dt, at = Scratch(a.spark), a.dtype, _order(op, lower)
    if a.meta.kind == "identity":
        return PreparedSolve(a, trans, op, lower, "identity", tmp)
    if method == "fold" or (method == "auto" and op.m <= FOLD_ROWS and _small(op, False)):
        if method == "fold":
            _small(op, True)
        re, im = _parts(dt.work(F.col("v")), dt)
        got = op.entries.select(at("i").cast("long").alias("p"), at("j").cast("long").alias("q"), re.alias("re"), im.alias("im")).toPandas()
        sent = a.spark.sparkContext.broadcast(_csr(got, op.m, dt.is_complex))
        return PreparedSolve(a, trans, op, lower, "fold", tmp, sent)
    if method != "blocks":
        try:
            lvl = tmp.cut(_peeled(op, MAX_LEVELS), "rows-of-levels")
        except ExecutionFailure:
            if method == "levels":
                raise
        else:
            v, lvl = dt.work(F.col("v")), by_size(lvl, op.m)
            rows = tmp.cut(op.entries.where("i = j").select("i", v.alias("d")).join(lvl, "i"), "rows")
            off = tmp.cut(op.entries.where("i <> j").select("i", "j", v.alias("a")).join(lvl, "i"), "off", by="level")
            of_level = dict(rows.groupBy("level").count().collect())  # MAX_LEVELS + 1 rows at most
            sizes = tuple(of_level[k] for k in range(len(of_level))) or (0,)
            return PreparedSolve(a, trans, op, lower, "levels", tmp, off, rows, tuple(tuple(range(k)) for k in range(len(sizes))), sizes)
    e = op.entries.select(at("i").cast("long").alias("p"), at("j").cast("long").alias("q"), dt.work(F.col("v")).alias("v"))
    e = e.withColumn("g", F.expr(f"p div {block_rows}")).withColumn("h", F.expr(f"q div {block_rows}"))
    blocks = max(1, -(-op.m // block_rows))
    pairs = tmp.cut(e.where("h < g").select("g", "h").distinct(), "pairs")
    if pairs.count() <= MAX_PAIRS:
        depends = defaultdict(list)
        known = pairs.toPandas()
        for g, h in zip(known.g.tolist(), known.h.tolist(), strict=True):
            depends[g].append(h)
        level = [0] * blocks
        for g in range(blocks):
            level[g] = 1 + max((level[h] for h in depends[g]), default=-1)
        needs = [set() for _ in range(max(level) + 1)]
        sizes = [block_rows * n for n in np.bincount(level).tolist()]
        for g, hs in depends.items():
            needs[level[g]].update(level[h] for h in hs)
        # a row for each block: 12 bytes for block_rows rows of the matrix
        of_block = a.spark.createDataFrame(pd.DataFrame({"g": np.arange(blocks), "level": np.array(level, np.int32)}), "g long, level int")
        e = e.join(F.broadcast(of_block), "g")
    else:
        needs, of_block, sizes = [range(g) for g in range(blocks)], None, [block_rows] * blocks
        e = e.withColumn("level", F.col("g").cast("int"))
    return PreparedSolve(a, trans, op, lower, "blocks", tmp, tmp.cut(e, "entries", by="level"), None, tuple(tuple(sorted(x)) for x in needs), tuple(sizes), block_rows, of_block)


# --- in one task -----------------------------------------------------------------------------


def _csr(e: pd.DataFrame, n: int, is_complex: bool, base: int = 0) -> tuple[np.ndarray, ...]:
    """Row pointers, columns and values below the diagonal, and the diagonal, of entries (p, q, re, im) of rows base to base + n - 1."""
    p, q = e.p.to_numpy() - base, e.q.to_numpy() - base
    v = e.re.to_numpy() + 1j * e.im.to_numpy() if is_complex else e.re.to_numpy(dtype=float)
    d = np.ones(n, v.dtype)
    d[p[p == q]] = v[p == q]
    below = np.flatnonzero(q < p)
    below = below[np.lexsort((q[below], p[below]))]
    return np.searchsorted(p[below], np.arange(n + 1)), q[below], v[below], d


def _substitute(ptr: np.ndarray, q: np.ndarray, v: np.ndarray, d: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Forward substitution for the columns of y."""
    x = y.astype(np.result_type(v, y))
    for r in range(len(d)):
        a, b = ptr[r], ptr[r + 1]
        if a < b:
            x[r] -= v[a:b] @ x[q[a:b]]
        x[r] /= d[r]
    return x


def _by_fold(s: PreparedSolve, rhs: DataFrame) -> DataFrame:
    dt, sent, m, at = s.op.dtype, s.entries, s.op.m, _order(s.op, s.lower)
    re, im = _parts(F.col("v"), dt)
    y = rhs.select("rhs", at("i").cast("long").alias("p"), re.alias("re"), im.alias("im"), F.floor(F.col("rhs") / PANEL).alias("panel"))
    is_complex = dt.is_complex

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        sides, k = np.unique(pdf.rhs.to_numpy(), return_inverse=True)
        ys = np.zeros((m, len(sides)), complex if is_complex else float)
        ys[pdf.p.to_numpy(), k] = pdf.re.to_numpy() + 1j * pdf.im.to_numpy() if is_complex else pdf.re.to_numpy()
        x = _substitute(*sent.value, ys)
        return pd.DataFrame({"rhs": np.tile(sides, m), "p": np.repeat(np.arange(m), len(sides)), "re": x.real.ravel(), "im": x.imag.ravel()})

    out = y.groupBy("panel").applyInPandas(solve, "rhs long, p long, re double, im double")
    return out.select("rhs", at("p").cast("long").alias("i"), (F.struct("re", "im") if is_complex else F.col("re")).alias("v"))


# --- panels of right-hand sides ----------------------------------------------------------------


class _Sides:
    """Right-hand sides as columns c0, c1, ... of panels. one: there is a single side, number 0."""

    def __init__(self, rhs: DataFrame, dt: DType, one: bool, tmp: Scratch):
        self.dt, self.one, self.n = dt, one, 1
        if not one:
            # a row for each side
            numbered = rhs.select("rhs").distinct().select("rhs", (F.row_number().over(Window.orderBy("rhs")) - 1).cast("long").alias("k"))
            self.numbers = tmp.cut(numbered, "sides")
            self.n = max(1, self.numbers.count())
        self.width = min(PANEL // 2 if dt.is_complex else PANEL, self.n)
        self.panels = -(-self.n // self.width)
        self.names = [f"c{k}" for k in range(self.width)]

    def each(self, f) -> list[Column]:
        return [f(c).alias(c) for c in self.names]

    def wide(self, rhs: DataFrame, *keys: str) -> DataFrame:
        """(rhs, keys, y) -> (panel, keys, c...)."""
        if self.one:
            return rhs.select(F.lit(0).cast("long").alias("panel"), *keys, F.col("y").alias("c0"))
        at = rhs.join(F.broadcast(self.numbers), "rhs").withColumn("panel", F.expr(f"k div {self.width}")).withColumn("slot", F.expr(f"k % {self.width}"))
        return at.groupBy("panel", *keys).agg(*[F.max(F.when(F.col("slot") == k, F.col("y"))).alias(c) for k, c in enumerate(self.names)])

    def long(self, x: DataFrame, key: str) -> DataFrame:
        """(panel, key, c...) -> (rhs, key, v)."""
        if self.one:
            return x.select(F.lit(0).cast("long").alias("rhs"), key, F.col("c0").alias("v"))
        flat = x.select("panel", key, F.posexplode(F.array(*self.names)).alias("slot", "v")).withColumn("k", F.col("panel") * self.width + F.col("slot"))
        return flat.join(F.broadcast(self.numbers), "k").select("rhs", key, "v")

    def less(self, here: DataFrame, entries: DataFrame, x: DataFrame | None, size: int, keys: tuple[str, ...], row: str, column: str) -> DataFrame:
        """here (panel, keys, c...) less the product of entries (row, column, a) with x (panel, column, c...), of at most `size` columns of the matrix."""
        if x is None:
            return here
        dt = self.dt
        sums = entries.join(by_size(x, size * self.panels), column).groupBy("panel", row).agg(*self.each(lambda c: dt.sum(dt.mul(F.col("a"), F.col(c)))))
        sums = sums.select("panel", row, *[F.col(c).alias(f"s{c}") for c in self.names])
        got = here.join(sums, ["panel", row], "left")
        return got.select("panel", *keys, *self.each(lambda c: dt.sub(F.col(c), dt.coalesce(F.col(f"s{c}"), dt.zero))))

    def local(self, entries: DataFrame, here: DataFrame, many: int) -> DataFrame:
        """entries (g, p, q, a), here (panel, g, p, c...) of at most `many` groups: every group's own triangular system for every panel -> (panel, p, c...). A group is a bounded range of p."""
        dt, names = self.dt, self.names
        re, im = _parts(F.col("a"), dt)
        groups = here.select(F.col("panel").alias("e_panel"), F.col("g").alias("e_g")).distinct()
        e = entries.join(by_size(groups, many * self.panels), F.col("g") == F.col("e_g")).select("e_panel", "e_g", "p", "q", re.alias("re"), im.alias("im"))
        flat = [(c, k, f"{c}{part}") for c in names for k, part in enumerate(("r", "i") if dt.is_complex else ("r",))]
        y = here.select("panel", "g", "p", *[F.coalesce(_parts(F.col(c), dt)[k], F.lit(0.0)).alias(name) for c, k, name in flat])
        is_complex, columns = dt.is_complex, [name for *_, name in flat]

        def solve(e: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            y = y.sort_values("p")
            base, values = int(y.p.iloc[0]), y[columns].to_numpy(dtype=float)
            x = _substitute(*_csr(e, len(y), is_complex, base), values[:, ::2] + 1j * values[:, 1::2] if is_complex else values)
            out = np.empty_like(values)
            if is_complex:
                out[:, ::2], out[:, 1::2] = x.real, x.imag
            else:
                out = x
            return pd.DataFrame({"panel": y.panel.to_numpy(), "p": y.p.to_numpy()} | {c: out[:, k] for k, c in enumerate(columns)})

        got = y.groupBy("panel", "g").cogroup(e.groupBy("e_panel", "e_g")).applyInPandas(lambda y, e: solve(e, y), "panel long, p long, " + ", ".join(f"{c} double" for c in columns))
        return got.select("panel", "p", *self.each(lambda c: F.struct(F.col(f"{c}r").alias("re"), F.col(f"{c}i").alias("im")) if is_complex else F.col(f"{c}r")))


def _by_rounds(s: PreparedSolve, tmp: Scratch, todo: DataFrame, solved) -> DataFrame:
    """solved(level, rows of todo, solutions that the level may read, their number at most) for one level after the other -> all solutions."""
    todo, done = tmp.cut(todo, "todo", by="level"), {}
    for k, needs in enumerate(s.needs):
        before = [done[h] for h in needs]
        x = None
        if before:
            x = s.op.spark.read.schema(done[needs[0]].schema).parquet(*[f"{tmp.root}/x-{h}" for h in needs])
        done[k] = tmp.cut(solved(k, todo.where(F.col("level") == k), x, sum(s.sizes[h] for h in needs)), f"x-{k}")
    tmp.drop("todo")
    return s.op.spark.read.schema(done[0].schema).parquet(*[f"{tmp.root}/x-{k}" for k in done])


def _by_levels(s: PreparedSolve, rhs: DataFrame, one: bool) -> DataFrame:
    dt, tmp = s.op.dtype, Scratch(s.op.spark)
    sides = _Sides(rhs, dt, one, tmp)
    todo = sides.wide(rhs.withColumnRenamed("v", "y"), "i").join(by_size(s.rows, s.op.m), "i")

    def solved(k, here, x, size):
        x = None if x is None else x.withColumnRenamed("i", "j")
        rest = sides.less(here, s.entries.where(F.col("level") == k), x, size, ("i", "d"), "i", "j")
        return rest.select("panel", "i", *sides.each(lambda c: dt.div(F.col(c), F.col("d"))))

    return sides.long(_by_rounds(s, tmp, todo, solved), "i")


def _by_blocks(s: PreparedSolve, rhs: DataFrame, one: bool) -> DataFrame:
    dt, tmp, at = s.op.dtype, Scratch(s.op.spark), _order(s.op, s.lower)
    sides = _Sides(rhs, dt, one, tmp)
    todo = sides.wide(rhs.select("rhs", at("i").cast("long").alias("p"), F.col("v").alias("y")), "p").withColumn("g", F.expr(f"p div {s.block_rows}"))
    todo = todo.withColumn("level", F.col("g").cast("int")) if s.of_block is None else todo.join(F.broadcast(s.of_block), "g")

    def solved(k, here, x, size):
        e = s.entries.where(F.col("level") == k).withColumnRenamed("v", "a")
        x = None if x is None else x.withColumnRenamed("p", "q")
        rest = sides.less(here, e.where("h < g").select("p", "q", "a"), x, size, ("g", "p"), "p", "q")
        return sides.local(e.where("h = g").select("g", "p", "q", "a"), rest, s.sizes[k] // s.block_rows)

    x = sides.long(_by_rounds(s, tmp, todo, solved), "p")
    return x.select("rhs", at("p").cast("long").alias("i"), "v")


# --- solves -----------------------------------------------------------------------------------


def _solve(a: SparseMatrix | PreparedSolve, y: DataFrame, alpha, trans, method: str, block_rows: int, one: bool) -> DataFrame:
    if isinstance(a, PreparedSolve):
        s = a
        if trans is not None and Trans.of(trans, 2) is not s.trans:
            raise InputParameterError(f"prepared for {s.trans.name}, not {Trans.of(trans, 2).name}", 2)
    elif alpha == 0:
        _checked(a, trans or "N")
    else:
        s = prepare(a, trans or "N", method, block_rows)
    dt = (a.matrix if isinstance(a, PreparedSolve) else a).dtype
    if alpha == 0:
        return y.select("rhs", "i", dt.store(dt.zero).alias("v"))
    rhs = y.select(F.col("rhs").cast("long").alias("rhs"), "i", dt.mul(dt.lit(alpha), dt.work(F.col("v"))).alias("v"))
    x = rhs if s.method == "identity" else _by_fold(s, rhs) if s.method == "fold" else (_by_levels if s.method == "levels" else _by_blocks)(s, rhs, one)
    return x.select("rhs", "i", dt.store(F.col("v")).alias("v"))


def spsm(a: SparseMatrix | PreparedSolve, y: DataFrame, alpha=1.0, trans: Trans | str | None = None, method: str = "auto", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """op(A) X = alpha Y: y (rhs, i, v) with every i of every rhs -> (rhs, i, v). alpha = 0: the matrix is checked, and zeros come back."""
    return _solve(a, y, alpha, trans, method, block_rows, False)


def spsv(a: SparseMatrix | PreparedSolve, y: DataFrame, alpha=1.0, trans: Trans | str | None = None, method: str = "auto", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """op(A) x = alpha y: y (i, v) -> (i, v)."""
    return _solve(a, y.withColumn("rhs", F.lit(0).cast("long")), alpha, trans, method, block_rows, True).select("i", "v")


def spsm_parts(a: SparseMatrix, parts: DataFrame, y: DataFrame, separator: int, alpha=1.0, trans: Trans | str = "N") -> DataFrame:
    """spsm of a matrix cut into parts that don't depend on each other, and a separator part: (i, part) for every row.

    Lower op(A): all parts at once, then a product into the separator, then the separator;
    upper: the separator first. A part must fit a task; parts and panels of right-hand sides
    run side by side.
    """
    op, lower = _checked(a, trans)
    dt, tmp = a.dtype, Scratch(a.spark)
    if alpha == 0:
        return y.select("rhs", "i", dt.store(dt.zero).alias("v"))
    at = _order(op, lower)
    order = parts.select("i", F.col("part").cast("long").alias("g"))
    # positions within a part are consecutive, in solving order
    place = tmp.cut(order.select("i", "g", (F.col("g") * F.lit(op.m) + F.row_number().over(Window.partitionBy("g").orderBy(at("i"))) - 1).cast("long").alias("p")), "places")
    size = place.agg(F.count("*").alias("rows"), F.count_if(F.col("g") == separator).alias("separator"), F.count_distinct("g").alias("parts")).first()
    of = lambda name, p, g: by_size(place.select(F.col("i").alias(name), F.col("p").alias(p), F.col("g").alias(g)), size["rows"])
    e = tmp.cut(op.entries.select("i", "j", dt.work(F.col("v")).alias("a")).join(of("i", "p", "g"), "i").join(of("j", "q", "h"), "j").drop("i", "j"), "entries")
    if e.where((F.col("g") != F.col("h")) & (F.col("g") != separator) & (F.col("h") != separator)).limit(1).count():
        raise InputParameterError("parts depend on each other", 2)
    rhs = y.select(F.col("rhs").cast("long").alias("rhs"), "i", dt.mul(dt.lit(alpha), dt.work(F.col("v"))).alias("y")).join(by_size(place, size["rows"]), "i").drop("i")
    sides = _Sides(rhs, dt, False, tmp)
    todo = tmp.cut(sides.wide(rhs, "g", "p"), "todo")
    own, across = e.where("g = h").select("g", "p", "q", "a"), e.where("g <> h").select("p", "q", "a")
    first = (F.col("g") != separator) if lower else (F.col("g") == separator)
    x = tmp.cut(sides.local(own, todo.where(first), size["parts"]), "x-0")
    known = size["rows"] - size["separator"] if lower else size["separator"]
    rest = sides.less(todo.where(~first), across, x.withColumnRenamed("p", "q"), known, ("g", "p"), "p", "q")
    x = x.unionByName(tmp.cut(sides.local(own, rest, size["parts"]), "x-1"))
    return sides.long(x.join(by_size(place.select("p", "i"), size["rows"]), "p").drop("p"), "i").select("rhs", "i", dt.store(F.col("v")).alias("v"))


def residual(a: SparseMatrix, x: DataFrame, y: DataFrame, alpha=1.0, trans: Trans | str = "N") -> DataFrame:
    """(rhs, absolute, relative): max |op(A) x - alpha y|, and over |A|inf |x|inf + |alpha y|inf."""
    from .products import norm_inf

    op, dt = a.op(trans), a.dtype
    terms = op.entries.select("i", "j", dt.work(F.col("v")).alias("a")).join(x.select("rhs", F.col("i").alias("j"), dt.work(F.col("v")).alias("x")), "j")
    ax = terms.groupBy("rhs", "i").agg(dt.sum(dt.mul(F.col("a"), F.col("x"))).alias("ax"))
    want = y.select("rhs", "i", dt.mul(dt.lit(alpha), dt.work(F.col("v"))).alias("y"))
    diff = want.join(ax, ["rhs", "i"], "left").select("rhs", dt.abs(dt.sub(dt.coalesce(F.col("ax"), dt.zero), F.col("y"))).alias("d"), dt.abs(F.col("y")).alias("y"))
    size = norm_inf(op)
    by = diff.groupBy("rhs").agg(F.max("d").alias("absolute"), F.max("y").alias("y"))
    xs = x.groupBy("rhs").agg(F.max(dt.abs(F.col("v"))).alias("x"))
    scale = F.lit(size) * F.col("x") + F.col("y")
    return by.join(xs, "rhs").select("rhs", "absolute", F.when(scale > 0, F.col("absolute") / F.when(scale > 0, scale)).otherwise(F.col("absolute")).alias("relative"))


def identity_rhs(spark: SparkSession, n: int) -> DataFrame:
    """The right-hand sides whose solutions are the inverse's columns."""
    return spark.range(n).select(F.col("id").alias("rhs"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("i")).select("rhs", "i", F.when(F.col("rhs") == F.col("i"), 1.0).otherwise(0.0).alias("v"))


__all__ = ["PreparedSolve", "prepare", "spsv", "spsm", "spsm_parts", "levels", "residual", "identity_rhs"]
