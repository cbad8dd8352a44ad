"""Triangular solves by every method, and the error contract."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_golden import values

from sparseframe.operators import optimize, solve, vector
from sparseframe.operators import products as P
from sparseframe.operators.matrix import identity, null
from sparseframe.plans.meta import ExecutionFailure, InputParameterError, get_reproducibility, reproducible, set_reproducibility
from sparseframe.sources import builders as B

LOW = ([0, 1, 3, 5, 6], [0, 0, 1, 1, 2, 3], [2, 1, 3, 1, 4, 1])


@pytest.mark.parametrize("method", ["fold", "levels", "blocks"])
def test_golden_solves(spark, method):
    a = B.from_csr(spark, 4, 4, *LOW)
    for trans, rhs in (("N", [2, 10, 11, 4]), ("T", [5, 11, 8, 4])):
        assert values(solve.spsv(a, vector.dense(spark, rhs), trans=trans, method=method, block_rows=2), 4) == pytest.approx([1, 3, 2, 4])


def test_identity_zero_and_upper(spark):
    i = identity(spark, 4)
    assert values(solve.spsv(i, vector.dense(spark, [2, -1, 3, 4]), 1.5), 4) == [3, -1.5, 4.5, 6]
    a = B.from_csr(spark, 4, 4, *LOW)
    assert values(solve.spsv(a, vector.dense(spark, [2, 10, 11, 4]), 0), 4) == [0, 0, 0, 0]
    assert values(solve.spsv(a.transpose(), vector.dense(spark, [5, 11, 8, 4])), 4) == pytest.approx([1, 3, 2, 4])


def test_complex_conjugate_solve(spark):
    d = np.array([[2 + 1j, 0, 0], [1, 1 - 1j, 0], [3j, -1, 4]])
    a = B.from_dense(spark, 3, 3, d.ravel().tolist(), dt="z")
    want = np.array([1 + 1j, 2, -1j])
    for method in ("fold", "levels", "blocks"):
        got = values(solve.spsv(a, vector.dense(spark, (d.conj().T @ want).tolist(), "z"), trans="C", method=method), 3)
        np.testing.assert_allclose(got, want, atol=1e-12)


def test_spsm_and_residual(spark):
    a = B.from_csr(spark, 5, 5, [0, 1, 3, 5, 7, 9], [0, 0, 1, 1, 2, 2, 3, 3, 4], [1, 2, 1, 3, 1, 4, 1, 5, 1])
    ys = [[1, 4, 9, 16, 25], [5, 14, 15, 14, 11], [2, 7, 8, 3, 19]]
    y = spark.createDataFrame([(r, i, float(v)) for r, c in enumerate(ys) for i, v in enumerate(c)], "rhs long, i long, v double")
    for method in ("fold", "levels", "blocks"):
        x = solve.spsm(a, y, method=method, block_rows=2)
        assert [values(x.where(F.col("rhs") == r), 5) for r in range(3)] == [[1, 2, 3, 4, 5], [5, 4, 3, 2, 1], [2, 3, -1, 7, -16]]
    assert {(r["absolute"], r["relative"]) for r in solve.residual(a, x, y).collect()} == {(0.0, 0.0)}


# A published 17 x 17 lower triangular matrix in six supernodes, and its right-hand side.
SUPER = dict(
    nsuper=6,
    nparts=2,
    super_row_ptr=[0, 6, 13, 17, 24, 29, 33],
    super_col_indx=[0, 2, 4, 7, 10, 13, 17],
    row_indx=[0, 1, 2, 3, 13, 15, 2, 3, 4, 5, 6, 13, 15, 4, 5, 6, 13, 7, 8, 9, 10, 12, 13, 15, 10, 11, 12, 13, 14, 13, 14, 15, 16],
    col_ptr=[0, 6, 12, 19, 26, 30, 34, 38, 45, 52, 59, 64, 69, 74, 78, 82, 86, 90],
    vals=[1, 1, 1, 1, 1, 9, 0, 2, 2, 2, 2, 8, 3, 3, 3, 3, 3, 3, 7, 0, 4, 4, 4, 4, 4, 6, 3, 4, 5, 5, 0, 2, 6, 6, 0, 0, 1, 7, 1, 1, 1, 1, 1, 8, 6, 0, 1, 1, 1, 1, 9, 5, 0, 0, 1, 1, 1, 1, 4, 2, 2, 2, 2, 1, 0, 3, 3, 3, 1, 0, 0, 4, 4, 1, 5, 1, 3, 4, 0, 1, 2, 3, 0, 0, 1, 2, 0, 0, 0, 1],
    part_indx=[0, 2, 3, 4, 5, 5],
)
RHS = [1, 3, 6, 10, 10, 13, 19, 1, 2, 3, 5, 5, 12, 60, 5, 51, 10]


def test_supernodal(spark):
    a, parts, sep = B.from_supernodal(spark, 17, 17, **SUPER)
    y = vector.dense(spark, RHS).withColumn("rhs", F.lit(0).cast("long"))
    assert values(solve.spsm_parts(a, parts, y, sep, 1.1).select("i", "v"), 17) == pytest.approx([1.1] * 17)
    d = np.zeros((17, 17))
    for r in a.entries.collect():
        d[r["i"], r["j"]] = r["v"]
    t = vector.dense(spark, (d.T @ np.ones(17)).tolist()).withColumn("rhs", F.lit(0).cast("long"))
    assert values(solve.spsm_parts(a, parts, t, sep, trans="T").select("i", "v"), 17) == pytest.approx([1] * 17)
    assert values(P.spmv(a, vector.dense(spark, [1] * 17)), 17) == RHS


@pytest.mark.parametrize(("dt", "method"), [("d", "fold"), ("d", "levels"), ("d", "blocks"), ("z", "levels"), ("z", "blocks"), ("z", "fold")])
def test_many_sides_in_panels_are_numpy_solves(spark, monkeypatch, dt, method):
    monkeypatch.setattr(solve, "PANEL", 4)
    r = np.random.default_rng(4)
    n, sides = 23, [0, 3, 4, 11, 12, 13, 900]
    d = np.tril(r.integers(-3, 4, (n, n)) * (r.random((n, n)) < 0.2), -1) + 2.0 * np.eye(n)
    d = d + 1j * np.tril(r.integers(-2, 3, (n, n)), -1) if dt == "z" else d
    x = r.integers(-4, 5, (n, len(sides))) + (1j if dt == "z" else 0)
    a = B.from_dense(spark, n, n, d.ravel().tolist(), dt=dt)
    put = lambda v: (v.real, v.imag) if dt == "z" else float(v.real)
    for trans, op in (("N", d), ("T", d.T), ("C", d.conj().T)):
        y = op @ x
        rows = [(s, i, put(complex(y[i, k]))) for k, s in enumerate(sides) for i in range(n)]
        got = solve.spsm(a, spark.createDataFrame(rows, f"rhs long, i long, v {a.dtype.ddl}"), trans=trans, method=method, block_rows=5)
        out = {(g["rhs"], g["i"]): complex(g["v"]["re"], g["v"]["im"]) if dt == "z" else g["v"] for g in got.collect()}
        assert len(out) == n * len(sides)
        np.testing.assert_allclose([[out[s, i] for s in sides] for i in range(n)], x, atol=1e-8)


def test_blocks_without_order_go_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(solve, "MAX_PAIRS", 0)
    a = B.from_csr(spark, 4, 4, *LOW)
    ready = solve.prepare(a, "N", "blocks", 2)
    assert ready.of_block is None and ready.needs == ((), (0,))
    assert values(solve.spsv(ready, vector.dense(spark, [2, 10, 11, 4])), 4) == pytest.approx([1, 3, 2, 4])
    monkeypatch.undo()
    free = B.from_coo(spark, 6, 6, [0, 1, 2, 3, 4, 5, 1, 3, 5], [0, 1, 2, 3, 4, 5, 0, 2, 0], [1] * 9)
    assert solve.prepare(free, "N", "blocks", 2).needs == ((), (0,)) and solve.prepare(free, "T", "blocks", 2).needs == ((), (0,))


def test_chain_falls_back_to_blocks(spark):
    n = 200
    rows = [(i, i, 2.0) for i in range(n)] + [(i, i - 1, 1.0) for i in range(1, n)]
    a = B.from_table(spark.createDataFrame(rows, "i long, j long, v double"), n, n)
    y = P.spmv(a, vector.dense(spark, [1] * n))
    assert values(solve.spsv(a, y, method="blocks", block_rows=80), n) == pytest.approx([1] * n)
    with pytest.raises(ExecutionFailure):
        solve.levels(a, limit=3)
    low = B.from_coo(spark, 4, 4, [0, 1, 2, 3, 2, 3], [0, 1, 2, 3, 0, 2], [1] * 6)
    assert {r["i"]: r["level"] for r in solve.levels(low).collect()} == {0: 0, 1: 0, 2: 1, 3: 2}


def test_solve_errors(spark):
    y = vector.dense(spark, [1, 1])
    for bad in (null(spark, 2, 2), B.from_dense(spark, 2, 2, [1, 2, 3, 4]), B.from_coo(spark, 2, 2, [0, 1], [0, 0], [1, 1])):
        with pytest.raises(InputParameterError):
            solve.spsv(bad, y)
    with pytest.raises(InputParameterError):
        solve.spsv(identity(spark, 2), y, trans="X")


def test_input_errors(spark):
    d, s = B.from_coo(spark, 2, 2, [0], [0], [1]), B.from_coo(spark, 2, 2, [0], [0], [1], "s")
    for f in (P.spmm, P.spadd, P.spelmm):
        with pytest.raises(InputParameterError) as e:
            f(d, s)
        assert e.value.status == 1 and e.value.arg_pos
    with pytest.raises(InputParameterError):
        P.sddmm(d, s, d)
    for f in (lambda: B.from_coo(spark, -1, 2, [], [], []), lambda: null(spark, 2, -1), lambda: B.from_csr(spark, 1, 1, [2, 2], [], []), lambda: B.from_dense(spark, 2, 2, [1] * 4, lda=1), lambda: B.from_bsr(spark, 3, 4, [0], [], [], 2)):
        with pytest.raises(InputParameterError):
            f()
    change = lambda i, j: spark.createDataFrame([(i, j, 1.0)], "i long, j long, v double")
    for i, j in ((5, 0), (0, 1)):
        with pytest.raises(InputParameterError):
            d.update(change(i, j))
    held = B.from_coo(spark, 2, 2, [0], [0], [1], no_copy=True)
    for f in (lambda: held.scale(2), lambda: held.transpose(), lambda: P.spnorm(d, "one"), lambda: d.hint("nothing", 1), lambda: d.hint("spmv_invocations", "often"), lambda: B.from_coo(spark, 2, 2, [0, 0], [0, 0], [1, 2], duplicates="error")):
        with pytest.raises(InputParameterError):
            f()
    assert B.from_coo(spark, 2, 2, [0, 0], [0, 0], [1, 2]).query()["nnz"] == 1
    assert d.hint("spmv_operation", "T").hint("spmv_invocations", "many").optimize().query()["nnz"] == 1


def test_reproducible_sums(spark):
    n = 2000
    rows = spark.range(n).select(F.lit(0).cast("long").alias("i"), F.col("id").alias("j"), (F.sin(F.col("id")) * F.pow(F.lit(10.0), F.col("id") % 17)).alias("v"))
    x = vector.dense(spark, [1] * n)
    with reproducible():
        assert get_reproducibility() == "reproducible"
        got = {values(P.spmv(B.from_table(rows.repartition(k), 1, n, duplicates="unique"), x), 1)[0] for k in (1, 3, 7)}
    assert len(got) == 1 and get_reproducibility() == "default"
    with pytest.raises(InputParameterError):
        set_reproducibility("sometimes")


def test_optimize_checks_and_prepares(spark, monkeypatch):
    a, b = B.from_csr(spark, 4, 4, *LOW), B.from_coo(spark, 4, 2, [0, 3], [1, 0], [1, 1])
    assert {tuple(r) for r in optimize.spmm_optimize(a, b).collect()} == {(0, 1), (1, 1), (3, 0)}
    assert optimize.spmv_optimize(a).query()["nnz"] == 6 and optimize.spadd_optimize(a, a) is None and optimize.spelmm_optimize(a, a, "T") is None
    strategy = lambda c: optimize.sddmm_optimize(a, b, c).meta.hints.get("sddmm_strategy")
    assert strategy(b) == "join" and strategy(B.from_dense(spark, 4, 2, [1] * 8)) == "arrays" and strategy(b.hint("sddmm_strategy", "arrays")) == "arrays"
    ways = [optimize.spsv_optimize(a)]
    monkeypatch.setattr(solve, "FOLD_ROWS", 2)
    ways.append(optimize.spsm_optimize(a))
    assert ways[1].rows.count() == 4
    monkeypatch.setattr(solve, "MAX_LEVELS", 1)
    ways.append(optimize.spsv_optimize(a))
    assert [w.method for w in ways] == ["fold", "levels", "blocks"]
    for ready in ways:
        for rhs in ([2, 10, 11, 4], [4, 20, 22, 8]):
            assert values(solve.spsv(ready, vector.dense(spark, rhs), 0.5), 4) == pytest.approx([rhs[0] / 4 * x for x in (1, 3, 2, 4)])
        assert values(solve.spsv(ready, vector.dense(spark, [1] * 4), 0), 4) == [0] * 4
        with pytest.raises(InputParameterError):
            solve.spsv(ready, vector.dense(spark, [1] * 4), trans="T")
        ready.destroy()
    hinted = a.hint("spsv_strategy", "blocks").hint("spsv_operation", "T")
    assert optimize.spsv_optimize(hinted).method == "blocks" and optimize.spsv_optimize(hinted).trans.name == "T"
    with pytest.raises(ExecutionFailure):
        solve.prepare(a, method="fold")
    for f in (lambda: optimize.spmm_optimize(b, b), lambda: optimize.spadd_optimize(a, b), lambda: optimize.sddmm_optimize(a, b, a), lambda: optimize.spsv_optimize(null(spark, 2, 2))):
        with pytest.raises(InputParameterError):
            f()


def test_table_solves_take_every_line_and_levels(spark, monkeypatch):
    from sparseframe import catalog

    d = "/root/testdata/sf0.01"
    lines = [tuple(r) for r in spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity").collect()]
    ns, np_, no = (spark.read.parquet(f"{d}/{t}.parquet").count() for t in ("supplier", "part", "orders"))
    want: dict = {}
    for o, p, s, v in lines:
        for e in ((ns + p, s), (ns + np_ + o, ns + p), (ns + np_ + o, s)):
            want[e] = want.get(e, 0.0) + v
    tiers = catalog.order_tiers(spark, d)
    got = {(r["i"], r["j"]): r["v"] for r in tiers.entries.collect()}
    assert tiers.m == ns + np_ + no and got == want | {(i, i): 2.0 for i in range(tiers.m)}
    # any right-hand side, by plain substitution; auto must take the levels
    x, below = np.zeros(tiers.m), [[] for _ in range(tiers.m)]
    for (i, j), v in want.items():
        below[i].append((j, v))
    for i in range(tiers.m):
        x[i] = (i % 11 - sum(v * x[j] for j, v in below[i])) / 2
    monkeypatch.setattr(solve, "_by_fold", None)
    monkeypatch.setattr(solve, "_by_blocks", None)
    y = spark.range(tiers.m).select(F.col("id").alias("i"), (F.col("id") % 11).cast("double").alias("v"))
    np.testing.assert_allclose(values(solve.spsv(tiers, y), tiers.m), x, rtol=1e-9)
    chain = catalog.part_supplier_triangle(spark, d).entries.where("i > j").agg(F.sum("v"), F.count_if(F.col("i") % 2 == F.col("j") % 2)).first()
    assert tuple(chain) == (sum(v for *_, v in lines), 0)
