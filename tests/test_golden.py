"""Hand-computed results for small matrices: construction, conversion, products, norms, updates, vectors."""

import math

import numpy as np
import pytest

from sparseframe.operators import products as P
from sparseframe.operators import vector
from sparseframe.operators.matrix import identity, null
from sparseframe.plans.meta import Diag, InputParameterError, Shape
from sparseframe.sources import builders as B
from sparseframe.sources import exports as E


def values(df, n):
    out = [None] * n
    for r in df.collect():
        out[r["i"]] = complex(r["v"]["re"], r["v"]["im"]) if hasattr(r["v"], "asDict") else r["v"]
    return out


def test_spmv(spark):
    a = B.from_csr(spark, 5, 5, [0, 2, 4, 7, 9, 12], [0, 2, 1, 3, 1, 2, 3, 2, 3, 2, 3, 4], range(1, 13))
    assert values(P.spmv(a, vector.dense(spark, [1] * 5)), 5) == [3, 7, 18, 17, 33]


def test_create_convert_export_update_scale_norm_transpose(spark):
    a = B.from_csr(spark, 4, 4, [0, 2, 3, 5, 6], [0, 2, 1, 0, 2, 3], range(1, 7))
    assert E.dense_array(a) == [1, 0, 2, 0, 0, 3, 0, 0, 4, 0, 5, 0, 0, 0, 0, 6]
    assert E.csr_arrays(a, 1)[:2] == ([1, 3, 4, 6, 7], [1, 3, 2, 1, 3, 4])
    assert E.csc_arrays(a, 0) == ([0, 2, 1, 0, 2, 3], [0, 2, 3, 5, 6], [1, 4, 3, 2, 5, 6])
    b = B.from_csc(spark, 4, 4, [0, 2, 1, 0, 2, 3], [0, 2, 3, 5, 6], [1, 4, 3, 2, 5, 6])
    assert E.dense_array(b) == E.dense_array(a)
    a = a.update(spark.createDataFrame([(0, 0, 2, 7.0), (1, 2, 0, 6.0)], "pos int, i long, j long, v double")).scale(0.5)
    assert P.spnorm(a, "inf") == 5.5
    assert P.spnorm(a, 1002) == pytest.approx(math.sqrt(39), abs=1e-12)
    assert E.dense_array(a.transpose()) == [0.5, 0, 3, 0, 0, 1.5, 0, 0, 3.5, 0, 2.5, 0, 0, 0, 0, 3]


def test_null_and_identity(spark):
    z, i = null(spark, 4, 4), identity(spark, 4)
    assert z.query()["nnz"] == 0 and E.dense_array(z) == [0] * 16
    assert i.query()["nnz"] == 4 and E.csr_arrays(i, 1)[0] == [1, 2, 3, 4, 5]
    assert values(P.spmv(i, vector.dense(spark, [1, 2, 3, 4])), 4) == [1, 2, 3, 4]
    t = null(spark, 2, 3).transpose()
    assert (t.m, t.n) == (3, 2)
    assert P.norm_frobenius(i) == 2 and P.norm_inf(i) == 1 and P.norm_inf(z) == 0 and P.norm_frobenius(z) == 0
    assert P.spmm(i, i).meta.kind == "identity"


def test_spadd(spark):
    a = B.from_csr(spark, 4, 4, [0, 1, 3, 4, 5], [0, 0, 1, 2, 3], [1, 2, 3, 4, 6])
    b = B.from_csr(spark, 4, 4, [0, 1, 2, 3, 4], [1, 0, 2, 3], [4, 5, -1, 2])
    assert E.dense_array(P.spadd(a, b, 2, -1)) == [2, -4, 0, 0, -1, 6, 0, 0, 0, 0, 9, 0, 0, 0, 0, 10]
    w = B.from_dense(spark, 2, 3, range(1, 7))
    assert E.dense_array(P.spadd(null(spark, 3, 2), w, 0, 1, "N", "T")) == [1, 4, 2, 5, 3, 6]


def test_spadd_keeps_cancelled_entries_and_reads_no_operand_at_zero(spark):
    a = B.from_coo(spark, 2, 2, [0], [0], [1])
    assert P.spadd(a, a, 1, -1).query()["nnz"] == 1
    nan = B.from_coo(spark, 2, 2, [1], [1], [float("nan")])
    assert E.dense_array(P.spadd(a, nan, 1, 0)) == [1, 0, 0, 0]
    y = vector.dense(spark, [float("nan")] * 2)
    assert values(P.spmv(a, vector.dense(spark, [2, 3]), 1, 0, y), 2) == [2, 0]
    assert values(P.spmv(nan, vector.dense(spark, [1, 1]), 0, 2, vector.dense(spark, [1, 2])), 2) == [2, 4]


A4 = ([0, 2, 4, 6, 8], [0, 2, 0, 1, 1, 2, 2, 3], [1, -1, 2, 3, 4, 5, 6, 7])


def test_spmm_all_transposes_with_beta(spark):
    a, b = B.from_csr(spark, 4, 4, *A4), B.from_dense(spark, 4, 4, range(1, 17))
    da, db = np.array(E.dense_array(a)).reshape(4, 4), np.arange(1, 17.0).reshape(4, 4)
    op = {"N": lambda x: x, "T": lambda x: x.T, "C": lambda x: x.conj().T}
    for ta, tb in (("N", "N"), ("T", "N"), ("N", "T"), ("T", "T"), ("C", "C")):
        got = E.dense_array(P.spmm(a, b, 0.7, 1.0, b, ta, tb))
        np.testing.assert_allclose(got, (0.7 * op[ta](da) @ op[tb](db) + db).ravel(), atol=1e-12)
    assert E.dense_array(P.spmm(a, b, 0, 2, b)) == (2 * db).ravel().tolist()


def test_mixed_bases_in_spadd(spark):
    a = B.from_csr(spark, 4, 4, [1, 3, 5, 7, 9], [1, 3, 1, 4, 2, 3, 1, 4], [1, -1, 2.5, 3, -0.5, 4, 1.5, -2])
    b = B.from_csr(spark, 4, 4, [0, 2, 4, 6, 8], [1, 3, 0, 2, 1, 3, 0, 2], [4, -2, 5, -1.5, 2, 3.5, -3, 1])
    da, db = (np.array(E.dense_array(x)).reshape(4, 4) for x in (a, b))
    assert E.dense_array(P.spadd(a, b, trans_b="T")) == (da + db.T).ravel().tolist()
    assert E.dense_array(P.spadd(a, b, 0, 1, trans_b="T")) == db.T.ravel().tolist()


ZA = ([0, 0, 1, 2, 2], [0, 2, 1, 0, 2], [1 + 1j, 2 - 1j, -1 + 2j, 3, 0.5 - 0.5j])
ZB = ([0, 0, 1, 2, 2], [0, 1, 1, 0, 2], [2 - 1j, 4, 1 + 1j, -1 + 2j, 3 + 1j])


def test_spelmm(spark):
    p, c = [0, 1, 3, 4, 6], [0, 0, 1, 2, 2, 3]
    a, b = B.from_csr(spark, 4, 4, p, c, range(1, 7)), B.from_csr(spark, 4, 4, p, c, range(4, 10))
    assert sorted(E.csr_arrays(P.spelmm(a, b))[2]) == [4, 10, 18, 28, 40, 54]
    x, y = B.from_coo(spark, 3, 3, *ZA, "z"), B.from_coo(spark, 3, 3, *ZB, "z")
    assert E.dense_array(P.spelmm(x, y)) == [3 + 1j, 0, 0, 0, -3 + 1j, 0, -3 + 6j, 0, 2 - 1j]
    dx, dy = (np.array(E.dense_array(v)).reshape(3, 3) for v in (x, y))
    np.testing.assert_allclose(E.dense_array(P.spelmm(x, y, 0.5 - 0.25j, trans_a="C", trans_b="T")), ((0.5 - 0.25j) * dx.conj().T * dy.T).ravel())


def test_sddmm(spark):
    mask = np.array([1, 1, 0, 1, 1, 0, 1, 0, 0, 1, 1, 1, 1, 0, 1, 1.0]).reshape(4, 4)
    a, b = np.arange(1, 17.0).reshape(4, 4), np.array([2, 1, 0, 1, 3, 2, 1, 0, 4, 3, 2, 1, 5, 4, 3, 2.0]).reshape(4, 4)
    ma, mb, mc = (B.from_dense(spark, 4, 4, x.ravel().tolist()) for x in (a, b, mask))
    assert E.dense_array(P.sddmm(ma, mb, mc)) == (a @ b * mask).ravel().tolist()
    assert E.dense_array(P.sddmm(ma, mb, mc, 2, -1, "T", "T")) == ((2 * a.T @ b.T) * mask - mask).ravel().tolist()
    rows = lambda x, k: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], f"{k} long, values array<double>")
    assert E.dense_array(P.sddmm_rows(rows(a, "i"), rows(b.T, "j"), mc)) == (a @ b * mask).ravel().tolist()
    assert P.sddmm(ma, mb, null(spark, 4, 4)).meta.kind == "null"
    for t in ("N", "T"):
        dense, joined = (E.dense_array(P.sddmm(ma, mb, mc.hint("sddmm_strategy", k), 2, -1, t, t)) for k in ("arrays", "join"))
        assert dense == joined


def test_complex_spmv(spark):
    a = B.from_coo(spark, 4, 4, [0, 0, 1, 2, 2], [0, 2, 1, 0, 2], [1 + 1j, 2 - 1j, -1 + 2j, 3, 4 - 2j], "z")
    x = vector.dense(spark, [1, 2, 3, 0], "z")
    assert values(P.spmv(a, x), 4) == [7 - 2j, -2 + 4j, 15 - 6j, 0]
    assert values(P.spmv(a, x, trans="T"), 4) == [10 + 1j, -2 + 4j, 14 - 7j, 0]
    assert values(P.spmv(a, x, trans="C"), 4) == [10 - 1j, -2 - 4j, 14 + 7j, 0]
    b = a.update(spark.createDataFrame([(1, 1, (5.0, -1.0))], "i long, j long, v struct<re: double, im: double>"))
    assert values(P.spmv(b, x), 4)[1] == 10 - 2j
    assert P.norm_inf(a) == pytest.approx(3 + math.sqrt(20), abs=1e-12)


def test_bsr(spark):
    a = B.from_bsr(spark, 4, 4, [0, 2, 4], [0, 1, 0, 1], range(1, 17), 2)
    x = vector.dense(spark, [1, 2, 3, 4])
    assert values(P.spmv(a, x), 4) == [44, 64, 124, 144]
    assert values(P.spmv(a, x, trans="T"), 4) == [78, 88, 118, 128]
    b = B.from_bsr(spark, 4, 4, [0, 1, 3], [0, 0, 1], range(1, 13), 2, "col")
    assert P.norm_inf(b) == 36
    assert values(P.spmv(b.transpose().scale(0.5), vector.dense(spark, [1] * 4)), 4) == [7, 11, 9.5, 11.5]
    assert E.bsr_arrays(a, 2) == ([0, 2, 4], [0, 1, 0, 1], list(range(1, 17)))
    assert E.bsr_arrays(b, 2, "col", 1) == ([1, 2, 4], [1, 1, 2], list(range(1, 13)))
    assert E.bsr_arrays(a) == E.bsr_arrays(a, 2) and E.bsr_arrays(a.convert("csr"))[0] == [0, 4, 8, 12, 16]
    ptr, cells = E.tables(b.transpose())
    assert ptr.count() == 3 and {len(r["values"]) for r in cells.collect()} == {4}


def test_conversions(spark):
    a = B.from_csr(spark, 4, 4, [0, 2, 3, 5, 6], [0, 2, 1, 0, 2, 3], range(1, 7))
    said = lambda df, *by: [tuple(r) for r in df.orderBy(*by).collect()]
    ptr, entries = E.tables(a.convert("csc"))
    assert [r[1] for r in said(ptr, "j")] == [0, 2, 3, 5, 6] and [r[1:] for r in said(entries.select("pos", "i", "v"), "pos")] == [(0, 1), (2, 4), (1, 3), (0, 2), (2, 5), (3, 6)]
    assert [r[1] for r in said(E.tables(a.convert("dense"))[0], "pos")] == E.dense_array(a) and len(E.tables(a.convert("coo"))) == 1
    with pytest.raises(InputParameterError):
        a.convert("bsr", 3)
    back = B.from_csc_tables(ptr, entries, 4, 4)
    assert E.dense_array(back) == E.dense_array(a) and back.meta.layout == "csc"


def test_dense_rows_in_panels(spark, monkeypatch):
    monkeypatch.setattr(P, "PANEL", 3)
    a = B.from_csr(spark, 4, 4, [0, 2, 2, 6, 8], [0, 2, 0, 1, 2, 3, 2, 3], [1, -1, 2, 3, 4, 5, 6, 7])
    da, b = np.array(E.dense_array(a)).reshape(4, 4), np.arange(28.0).reshape(4, 7)
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(b)], "i long, values array<double>")
    for trans, x in (("N", da), ("T", da.T)):
        got = {r["i"]: r["values"] for r in P.spmm_rows(a, rows, 7, 2.0, trans).collect()}
        np.testing.assert_allclose([got[i] for i in range(4)], 2 * x @ b)
    with pytest.raises(InputParameterError):
        P.spmm_rows(identity(spark, 4, "z"), rows, 7)


def test_vectors(spark):
    y = [0.0] * 100
    y[1], y[3], y[5] = 4, -1, 2
    x = vector.gather(vector.dense(spark, y), 100)
    assert [(r["i"], r["v"]) for r in x.export().collect()] == [(1, 4), (3, -1), (5, 2)]
    w = vector.dense(spark, [1, 2, 3, 4, 5, 6] + [0] * 94)
    x = x.update(spark.createDataFrame([(0, 1, 10.0), (1, 5, -2.0)], "pos int, i long, v double"))
    assert x.dot(w) == 20 - 4 - 12
    assert values(x.axpby(2, -1, w), 100)[:7] == [-1, 18, -3, -6, -5, -10, 0]
    got = values(x.waxpby(0.5, 2, vector.dense(spark, [1] * 100)), 100)
    assert got[1] == 7 and got[3] == 1.5 and got[5] == 1 and got[0] == 2
    xs, ys = x.rot(vector.dense(spark, [2] * 100), 0, 1)
    assert [values(ys, 100)[i] for i in (1, 3, 5, 0)] == [-10, 1, 2, 2] and {r["v"] for r in xs.entries.collect()} == {2}
    assert values(x.scatter(), 100)[1] == 10
    u = vector.create(spark, 5, [1, 2], [1, -2], index_base=1)
    assert u.query() == {"index_base": 1, "n": 5, "nnz": 2} and [r["i"] for r in u.export().collect()] == [1, 2]
    assert vector.create(spark, 3, [], []).dot(w) == 0


def test_complex_dot_and_structure(spark):
    x = vector.create(spark, 3, [0, 2], [1 + 1j, 2], "z")
    y = vector.dense(spark, [1 + 1j, 5, 3 - 1j], "z")
    assert x.dot(y) == (1 + 1j) ** 2 + 2 * (3 - 1j) and x.dot(y, conjugate=True) == 2 + 2 * (3 - 1j)
    low = B.from_coo(spark, 3, 3, [0, 1, 1, 2], [0, 0, 1, 2], [1, 5, 1, 1])
    assert low.structure() == (Shape.LOWER, Diag.UNIT) and low.transpose().structure() == (Shape.UPPER, Diag.UNIT)
    assert B.from_coo(spark, 2, 2, [0, 1], [1, 0], [1, 1]).structure() == (Shape.RECTANGULAR, Diag.ZERO)
    assert B.from_coo(spark, 2, 4, [0, 0, 0], [0, 1, 3], [1, 1, 1]).mgmd() == pytest.approx(2 ** (1 / 3) / 2)
    assert B.from_coo(spark, 3, 4, [0, 1, 1], [2, 0, 3], [1, 1, 1]).mgmd() == pytest.approx((1 + math.sqrt(3)) / 3)
    assert null(spark, 0, 3).mgmd() == null(spark, 2, 2).mgmd() == 0


def test_norm_ranges(spark):
    big = B.from_coo(spark, 2, 2, [0, 1], [0, 1], [3e200, 4e200])
    assert P.norm_frobenius(big) == pytest.approx(5e200)
    small = B.from_coo(spark, 2, 2, [0, 1], [0, 1], [3e-200, 4e-200])
    assert P.norm_frobenius(small) == pytest.approx(5e-200)
    nan = B.from_coo(spark, 2, 2, [0, 1], [0, 1], [float("nan"), 4])
    assert math.isnan(P.norm_frobenius(nan)) and math.isnan(P.norm_inf(nan))


def test_updates_meet_the_matrix_once_and_are_all_or_nothing(spark):
    a = B.from_coo(spark, 3, 3, [0, 1, 2], [0, 1, 2], [1, 2, 3])
    change = lambda *rows: spark.createDataFrame(list(rows), "pos int, i long, j long, v double")
    b = a.update(change((0, 1, 1, 5.0), (1, 1, 1, 7.0), (0, 2, 2, None)))
    assert [r["v"] for r in b.entries.orderBy("i").collect()] == [1, 7, None] and len(b.held) == 1
    b.destroy()
    assert b.query()["nnz"] == 3
    for bad, said in (((0, 3, 0, 1.0), "range"), ((0, 0, 1, 1.0), "not stored"), ((0, -1, 0, 1.0), "range")):
        with pytest.raises(InputParameterError, match=said):
            a.update(change((0, 1, 1, 5.0), bad))


def test_matrix_market(spark, tmp_path):
    f = tmp_path / "a.mtx"
    f.write_text("%%MatrixMarket matrix coordinate real skew-symmetric\n% note\n3 3 2\n2 1 5\n3 2 1.5\n")
    assert E.dense_array(B.read_matrix_market(spark, str(f))) == [0, -5, 0, 5, 0, -1.5, 0, 1.5, 0]
    f.write_text("%%MatrixMarket matrix coordinate pattern symmetric\n2 2 2\n1 1\n2 1\n")
    assert E.dense_array(B.read_matrix_market(spark, str(f), "lower")) == [1, 0, 1, 0]
    a = B.from_coo(spark, 3, 2, [0, 2], [1, 0], [1.5, -2])
    B.write_matrix_market(a, str(tmp_path / "b.mtx"))
    assert E.dense_array(B.read_matrix_market(spark, str(tmp_path / "b.mtx"))) == E.dense_array(a)
    f.write_text("%%MatrixMarket matrix coordinate complex general\n1 1 0\n")
    with pytest.raises(InputParameterError):
        B.read_matrix_market(spark, str(f))
