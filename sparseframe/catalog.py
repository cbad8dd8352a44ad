"""Matrices and vectors of the star-schema tables, and one query per operator over them with the SQL that states its rows.

Values are whole numbers or halves, so sums are exact in any order; where they aren't, both sides round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import optimize, solve, vector
from .operators import products as P
from .operators.matrix import SparseMatrix, identity, null
from .plans.meta import SparseError, reproducible
from .plans.shared import Scratch
from .sources import builders, exports

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# --- the relations, in SQL and as matrices --------------------------------------------------

_A = "SELECT l_partkey AS i, l_suppkey AS j, SUM(l_quantity) AS v FROM lineitem GROUP BY 1, 2"
_R = "SELECT l_partkey AS i, l_suppkey AS j, CAST(COUNT(*) AS DOUBLE) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2"
_S = "SELECT s_suppkey AS i, CAST(s_nationkey AS BIGINT) AS j, CAST(1 AS DOUBLE) AS v FROM supplier"
_X = "SELECT s_suppkey AS i, CAST(s_suppkey % 7 AS DOUBLE) AS v FROM supplier"
_XP = "SELECT p_partkey AS i, CAST(p_partkey % 5 AS DOUBLE) AS v FROM part"
_C = "SELECT p_partkey AS i, CAST(p_partkey * 7 % 25 AS BIGINT) AS j, CAST(p_size AS DOUBLE) AS v FROM part"
def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _size(spark: SparkSession, d: str, name: str) -> int:
    return _t(spark, d, name).count()


def parts_by_suppliers(spark: SparkSession, d: str) -> SparseMatrix:
    """Quantities by part and supplier."""
    e = _t(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    return builders.from_table(e, _size(spark, d, "part"), _size(spark, d, "supplier"), i="l_partkey", j="l_suppkey", v="l_quantity")


def returns(spark: SparkSession, d: str) -> SparseMatrix:
    """Numbers of returned lines by part and supplier."""
    e = _t(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_partkey", "l_suppkey", F.lit(1.0).alias("one"))
    return builders.from_table(e, _size(spark, d, "part"), _size(spark, d, "supplier"), i="l_partkey", j="l_suppkey", v="one")


def suppliers_by_nations(spark: SparkSession, d: str) -> SparseMatrix:
    e = _t(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.lit(1.0).alias("one"))
    return builders.from_table(e, _size(spark, d, "supplier"), 25, i="s_suppkey", j="s_nationkey", v="one", duplicates="unique")


def sample_pattern(spark: SparkSession, d: str) -> SparseMatrix:
    e = _t(spark, d, "part").select("p_partkey", (F.col("p_partkey") * 7 % 25).alias("c"), F.col("p_size").cast("double").alias("v"))
    return builders.from_table(e, _size(spark, d, "part"), 25, i="p_partkey", j="c", v="v", duplicates="unique")


def supplier_vector(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "supplier").select(F.col("s_suppkey").alias("i"), (F.col("s_suppkey") % 7).cast("double").alias("v"))


def part_vector(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select(F.col("p_partkey").alias("i"), (F.col("p_partkey") % 5).cast("double").alias("v"))


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- products -----------------------------------------------------------------------------------

_SPMV = f"SELECT p_partkey AS i, coalesce(s, 0) AS v FROM part LEFT JOIN (SELECT a.i, SUM(a.v * x.v) AS s FROM ({_A}) a JOIN ({_X}) x ON a.j = x.i GROUP BY a.i) q ON q.i = p_partkey"


@_query(_SPMV)
def spmv(spark, d):
    return P.spmv(parts_by_suppliers(spark, d), supplier_vector(spark, d))


@_query(f"SELECT s_suppkey AS i, coalesce(s, 0) AS v FROM supplier LEFT JOIN (SELECT a.j, SUM(a.v * x.v) AS s FROM ({_A}) a JOIN ({_XP}) x ON a.i = x.i GROUP BY a.j) q ON q.j = s_suppkey")
def spmv_trans(spark, d):
    return P.spmv(parts_by_suppliers(spark, d), part_vector(spark, d), trans="T")


@_query(f"SELECT y.i, 2 * coalesce(s, 0) + 0.5 * y.v AS v FROM ({_XP}) y LEFT JOIN (SELECT a.i, SUM(a.v * x.v) AS s FROM ({_A}) a JOIN ({_X}) x ON a.j = x.i GROUP BY a.i) q ON q.i = y.i")
def spmv_beta(spark, d):
    return P.spmv(parts_by_suppliers(spark, d), supplier_vector(spark, d), 2.0, 0.5, part_vector(spark, d))


@_query(_SPMV)
def spmv_reproducible(spark, d):
    with reproducible():
        return P.spmv(parts_by_suppliers(spark, d), supplier_vector(spark, d))


@_query(_SPMV)
def spmv_single_precision(spark, d):
    a = parts_by_suppliers(spark, d)
    a = builders.from_table(a.entries, a.m, a.n, "s", duplicates="unique")
    return P.spmv(a, supplier_vector(spark, d)).select("i", F.col("v").cast("double").alias("v"))


@_query(f"SELECT p_partkey AS i, coalesce(re, 0) AS re, coalesce(im, 0) AS im FROM part LEFT JOIN (SELECT a.i, SUM(a.v * x.v) AS re, SUM(-(a.v + 1) * x.v) AS im FROM ({_A}) a JOIN ({_X}) x ON a.j = x.i GROUP BY a.i) q ON q.i = p_partkey")
def spmv_complex_conjugate(spark, d):
    """A^H x of the transpose with entries v + (v + 1) i."""
    a = parts_by_suppliers(spark, d)
    e = a.entries.select(F.col("j").alias("i"), F.col("i").alias("j"), F.struct(F.col("v").alias("re"), (F.col("v") + 1).alias("im")).alias("v"))
    z = builders.from_table(e, a.n, a.m, "z", duplicates="unique")
    x = supplier_vector(spark, d).select("i", F.struct(F.col("v").alias("re"), F.lit(0.0).alias("im")).alias("v"))
    return P.spmv(z, x, trans="C").select("i", "v.re", "v.im")


_SPMM = f"SELECT a.i, b.j, SUM(a.v * b.v) AS v FROM ({_A}) a JOIN ({_S}) b ON a.j = b.i GROUP BY a.i, b.j"


@_query(_SPMM)
def spmm(spark, d):
    return P.spmm(parts_by_suppliers(spark, d), suppliers_by_nations(spark, d)).entries


@_query(f"SELECT i, j, SUM(v) AS v FROM (SELECT i, j, 2 * v AS v FROM ({_SPMM}) UNION ALL SELECT i, j, -v AS v FROM ({_C})) GROUP BY i, j")
def spmm_beta(spark, d):
    return P.spmm(parts_by_suppliers(spark, d), suppliers_by_nations(spark, d), 2.0, -1.0, sample_pattern(spark, d)).entries


@_query(f"SELECT a.j AS i, b.j AS j, SUM(a.v * b.v) AS v FROM ({_R}) a JOIN ({_R}) b ON a.i = b.i GROUP BY a.j, b.j")
def spmm_self(spark, d):
    r = returns(spark, d)
    return P.spmm(r, r, trans_a="T").entries


@_query(f"SELECT a.i, k AS j, SUM(a.v * ((a.j + k) % 5)) AS v FROM ({_A}) a, (SELECT range AS k FROM range(4)) GROUP BY a.i, k")
def spmm_dense(spark, d):
    """A sparse matrix times a dense one of four columns, zeros kept."""
    a = parts_by_suppliers(spark, d)
    rows = spark.range(a.n).select(F.col("id").alias("i"), F.array(*[((F.col("id") + k) % 5).cast("double") for k in range(4)]).alias("values"))
    return P.spmm(a, builders.from_rows(rows, a.n, 4, keep_zeros=True)).entries


@_query(f"SELECT p_partkey AS i, k AS j, coalesce(SUM(a.v * ((a.j + k) % 5)), 0) AS v FROM part CROSS JOIN (SELECT range AS k FROM range(100)) LEFT JOIN ({_A}) a ON a.i = p_partkey GROUP BY 1, 2")
def spmm_dense_rows(spark, d):
    """A sparse matrix times the rows of a dense one of 100 columns, in panels."""
    a = parts_by_suppliers(spark, d)
    rows = spark.range(a.n).select(F.col("id").alias("i"), F.transform(F.sequence(F.lit(0), F.lit(99)), lambda k: ((F.col("id") + k) % 5).cast("double")).alias("values"))
    return P.spmm_rows(a, rows, 100).select("i", F.posexplode("values").alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), "v")


@_query(f"SELECT k AS i, a.j, SUM(((a.i + k) % 5) * a.v) AS v FROM ({_A}) a, (SELECT range AS k FROM range(4)) GROUP BY 1, 2")
def spmm_dense_sparse(spark, d):
    """A dense matrix of four rows, zeros kept, times a sparse one."""
    a = parts_by_suppliers(spark, d)
    rows = spark.range(4).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(a.m - 1).cast("long"))).alias("j")).select("i", "j", ((F.col("i") + F.col("j")) % 5).cast("double").alias("v"))
    return P.spmm(builders.from_table(rows, 4, a.m, duplicates="unique"), a).entries


@_query("SELECT vec_id AS i, CAST(c AS BIGINT) AS j, round(list_sum(list_transform(range(64), lambda k: CAST(embedding[k + 1] AS DOUBLE) * ((k * c) % 7 - 3))), 6) AS v FROM embeddings, (SELECT range AS c FROM range(8))")
def spmm_dense_dense(spark, d):
    """Embeddings times a dense matrix of eight columns, kept as rows."""
    e = _t(spark, d, "embeddings")
    a = builders.from_rows(e, e.count(), 64, "vec_id", "embedding", keep_zeros=True)
    b = spark.range(64).select(F.col("id").alias("i"), F.array(*[(F.col("id") * c % 7 - 3).cast("double") for c in range(8)]).alias("values"))
    return P.spmm_rows(a, b, 8).select("i", F.posexplode("values").alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), F.round("v", 6).alias("v"))


@_query(f"SELECT i, j, v FROM ({_A})")
def spmm_identity(spark, d):
    a = parts_by_suppliers(spark, d)
    return P.spmm(identity(spark, a.m), P.spmm(a, identity(spark, a.n))).entries


@_query(f"SELECT DISTINCT a.i, b.j FROM ({_A}) a JOIN ({_S}) b ON a.j = b.i")
def spmm_pattern(spark, d):
    return P.spmm_pattern(parts_by_suppliers(spark, d), suppliers_by_nations(spark, d))


@_query(f"SELECT i, j, SUM(v) AS v FROM (SELECT i, j, 2 * v AS v FROM ({_A}) UNION ALL SELECT i, j, -v AS v FROM ({_R})) GROUP BY i, j")
def spadd(spark, d):
    return P.spadd(parts_by_suppliers(spark, d), returns(spark, d), 2.0, -1.0).entries


@_query(f"SELECT j AS i, i AS j, SUM(v) AS v FROM (SELECT i, j, v FROM ({_A}) UNION ALL SELECT i, j, 0.5 * v AS v FROM ({_R})) GROUP BY i, j")
def spadd_trans(spark, d):
    return P.spadd(parts_by_suppliers(spark, d), returns(spark, d), 1.0, 0.5, "T", "T").entries


@_query(f"SELECT i, j, v FROM ({_R})")
def spadd_null(spark, d):
    r = returns(spark, d)
    return P.spadd(null(spark, r.m, r.n), r).entries


@_query(f"SELECT a.i, a.j, a.v * b.v AS v FROM ({_A}) a JOIN ({_R}) b ON a.i = b.i AND a.j = b.j")
def spelmm(spark, d):
    return P.spelmm(parts_by_suppliers(spark, d), returns(spark, d)).entries


@_query(f"SELECT i, j, SUM(v) AS v FROM (SELECT a.i, a.j, 3 * a.v * b.v AS v FROM ({_A}) a JOIN ({_R}) b ON a.i = b.i AND a.j = b.j UNION ALL SELECT i, j, 0.5 * v AS v FROM ({_A})) GROUP BY i, j")
def spelmm_beta(spark, d):
    a = parts_by_suppliers(spark, d)
    return P.spelmm(a, returns(spark, d), 3.0, 0.5, a).entries


_SAMPLED = f"SELECT c.i, c.j, c.v AS c, SUM(a.v * b.v) AS s FROM ({_C}) c LEFT JOIN ({_A}) a ON a.i = c.i LEFT JOIN ({_S}) b ON b.i = a.j AND b.j = c.j GROUP BY c.i, c.j, c.v"


@_query(f"SELECT i, j, coalesce(s, 0) AS v FROM ({_SAMPLED})")
def sddmm(spark, d):
    return P.sddmm(parts_by_suppliers(spark, d), suppliers_by_nations(spark, d), sample_pattern(spark, d)).entries


@_query(f"SELECT i, j, 2 * coalesce(s, 0) - 0.5 * c AS v FROM ({_SAMPLED})")
def sddmm_beta(spark, d):
    return P.sddmm(parts_by_suppliers(spark, d), suppliers_by_nations(spark, d), sample_pattern(spark, d), 2.0, -0.5).entries


@_query(
    """SELECT c.i, c.j, round(list_sum(list_transform(range(1, 65), lambda k: CAST(a.embedding[k] AS DOUBLE) * CAST(b.embedding[k] AS DOUBLE))), 6) AS v
FROM (SELECT vec_id AS i, (vec_id + s) % (SELECT count(*) FROM embeddings) AS j FROM embeddings, (VALUES (1), (7), (31)) q(s)) c
JOIN embeddings a ON a.vec_id = c.i JOIN embeddings b ON b.vec_id = c.j"""
)
def sddmm_dense_rows(spark, d):
    e = _t(spark, d, "embeddings")
    n = e.count()
    pattern = e.select(F.col("vec_id").alias("i"), F.explode(F.array(F.lit(1), F.lit(7), F.lit(31))).alias("s")).select("i", ((F.col("i") + F.col("s")) % n).alias("j"), F.lit(1.0).alias("v"))
    c = builders.from_table(pattern, n, n, duplicates="unique")
    out = P.sddmm_rows(e.select(F.col("vec_id").alias("i"), F.col("embedding").alias("values")), e.select(F.col("vec_id").alias("j"), F.col("embedding").alias("values")), c)
    return out.entries.select("i", "j", F.round("v", 6).alias("v"))


# --- preparation ---------------------------------------------------------------------------------


@_query(_SPMV)
def spmv_optimized(spark, d):
    """Hinted, prepared, then run."""
    a = optimize.spmv_optimize(parts_by_suppliers(spark, d).hint("spmv_operation", "N").hint("spmv_invocations", "many"))
    return P.spmv(a, supplier_vector(spark, d))


@_query(f"SELECT count(*) AS nnz, (SELECT SUM(v) FROM ({_SPMM})) AS total FROM ({_SPMM})")
def spmm_optimized(spark, d):
    """The pattern prepared, and the product as large as it says."""
    a, s = parts_by_suppliers(spark, d).hint("spmm_strategy", "broadcast"), suppliers_by_nations(spark, d)
    pattern = optimize.spmm_optimize(a, s)
    total = P.spmm(a, s).entries.join(pattern, ["i", "j"], "left_semi").agg(F.sum("v")).first()[0]
    return spark.createDataFrame([(pattern.count(), total)], "nnz long, total double")


@_query(f"SELECT i, j, SUM(v) AS v FROM (SELECT i, j, 2 * v AS v FROM ({_A}) UNION ALL SELECT i, j, -v AS v FROM ({_R})) GROUP BY i, j")
def spadd_optimized(spark, d):
    a, r = parts_by_suppliers(spark, d), returns(spark, d)
    optimize.spadd_optimize(a, r)
    return P.spadd(a, r, 2.0, -1.0).entries


@_query(f"SELECT a.i, a.j, a.v * b.v AS v FROM ({_A}) a JOIN ({_R}) b ON a.i = b.i AND a.j = b.j")
def spelmm_optimized(spark, d):
    a, r = parts_by_suppliers(spark, d), returns(spark, d)
    optimize.spelmm_optimize(a, r)
    return P.spelmm(a, r).entries


@_query(f"SELECT m.i, m.j, 2 * coalesce(s, 0) - 0.5 AS v FROM (SELECT x.range AS i, y.range AS j FROM range(25) x, range(25) y WHERE (x.range + y.range) % 3 <> 0 OR x.range = y.range) m LEFT JOIN (SELECT a.j AS i, b.j AS j, SUM(a.v * b.v) AS s FROM ({_S}) a JOIN ({_S}) b ON a.i = b.i GROUP BY 1, 2) q ON q.i = m.i AND q.j = m.j")
def sddmm_optimized(spark, d):
    """A mask that is mostly stored: preparation picks dense rows, and the product obeys."""
    s = suppliers_by_nations(spark, d)
    cells = spark.range(625).select((F.expr("id div 25")).alias("i"), (F.col("id") % 25).alias("j"), F.lit(1.0).alias("v")).where("(i + j) % 3 <> 0 or i = j")
    c = optimize.sddmm_optimize(s, s, builders.from_table(cells, 25, 25, duplicates="unique"), "T")
    assert c.meta.hints.get("sddmm_strategy") == "arrays"
    return P.sddmm(s, s, c, 2.0, -0.5, "T").entries


# --- element-wise, norms, facts ---------------------------------------------------------------


@_query(f"SELECT i, j, 0.5 * v AS v FROM ({_A})")
def scale(spark, d):
    return parts_by_suppliers(spark, d).scale(0.5).entries


@_query(f"SELECT j AS i, i AS j, v FROM ({_A})")
def transpose(spark, d):
    return parts_by_suppliers(spark, d).transpose().entries


@_query(f"SELECT j AS i, i AS j, v AS re, -(v + 1) AS im FROM ({_A})")
def transpose_conjugate(spark, d):
    a = parts_by_suppliers(spark, d)
    z = builders.from_table(a.entries.select("i", "j", F.struct(F.col("v").alias("re"), (F.col("v") + 1).alias("im")).alias("v")), a.m, a.n, "z", duplicates="unique")
    return z.transpose("C").entries.select("i", "j", "v.re", "v.im")


@_query(f"SELECT MAX(s) AS norm FROM (SELECT SUM(abs(v)) AS s FROM ({_A}) GROUP BY i)")
def norm_inf(spark, d):
    return spark.createDataFrame([(P.norm_inf(parts_by_suppliers(spark, d)),)], "norm double")


@_query(f"SELECT round(sqrt(SUM(v * v)), 6) AS norm FROM ({_A})")
def norm_frobenius(spark, d):
    return spark.createDataFrame([(round(P.norm_frobenius(parts_by_suppliers(spark, d)), 6),)], "norm double")


@_query(f"SELECT round(MAX(s), 6) AS inf, round(sqrt(SUM(q)), 6) AS frobenius FROM (SELECT SUM(sqrt(v * v + (v + 1) * (v + 1))) AS s, SUM(v * v + (v + 1) * (v + 1)) AS q FROM ({_A}) GROUP BY i)")
def norm_complex(spark, d):
    a = parts_by_suppliers(spark, d)
    z = builders.from_table(a.entries.select("i", "j", F.struct(F.col("v").alias("re"), (F.col("v") + 1).alias("im")).alias("v")), a.m, a.n, "z", duplicates="unique")
    return spark.createDataFrame([(round(P.norm_inf(z), 6), round(P.norm_frobenius(z), 6))], "inf double, frobenius double")


@_query("SELECT CAST(1 AS DOUBLE) AS inf, round(sqrt(count(*)), 6) AS frobenius, CAST(0 AS DOUBLE) AS null_inf, CAST(0 AS DOUBLE) AS null_frobenius FROM part")
def norm_shortcuts(spark, d):
    n = _size(spark, d, "part")
    i, z = identity(spark, n), null(spark, n, n)
    return spark.createDataFrame([(P.norm_inf(i), round(P.norm_frobenius(i), 6), P.norm_inf(z), P.norm_frobenius(z))], "inf double, frobenius double, null_inf double, null_frobenius double")


@_query("SELECT * FROM (VALUES ('spmm', 1, 5), ('spadd', 1, 4), ('spsv', 1, 1), ('update', 1, 3), ('spnorm', 1, 2)) t(call, status, arg_pos)")
def last_error(spark, d):
    """Calls that must fail, with the status and the argument that their errors give."""
    a, s = parts_by_suppliers(spark, d), suppliers_by_nations(spark, d)
    calls = {
        "spmm": lambda: P.spmm(s, a),
        "spadd": lambda: P.spadd(a, s),
        "spsv": lambda: solve.spsv(null(spark, a.m, a.m), part_vector(spark, d)),
        "update": lambda: a.update(spark.createDataFrame([(a.m, 0, 1.0)], "i long, j long, v double")),
        "spnorm": lambda: P.spnorm(a, "one"),
    }
    rows = []
    for name, call in calls.items():
        try:
            call()
        except SparseError as e:
            rows.append((name, e.status, e.arg_pos))
    return spark.createDataFrame(rows, "call string, status int, arg_pos int")


@_query(f"SELECT a.i, a.j, coalesce(u.v, a.v) AS v FROM ({_A}) a LEFT JOIN (SELECT i, j, -v AS v FROM ({_R})) u ON a.i = u.i AND a.j = u.j")
def update(spark, d):
    changes = returns(spark, d).entries.select("i", "j", (-F.col("v")).alias("v"))
    return parts_by_suppliers(spark, d).update(changes.withColumn("pos", F.lit(0))).entries


@_query(f"SELECT i, count(*) AS nnz FROM ({_A}) GROUP BY i")
def row_counts(spark, d):
    return parts_by_suppliers(spark, d).row_counts()


@_query(f"SELECT round(SUM(g) / (SELECT count(*) FROM part), 6) AS mgmd FROM (SELECT exp(coalesce(SUM(ln(g)), 0) / count(*)) AS g FROM (SELECT i, j - lag(j) OVER (PARTITION BY i ORDER BY j) AS g FROM ({_A})) GROUP BY i)")
def mgmd(spark, d):
    return spark.createDataFrame([(round(parts_by_suppliers(spark, d).mgmd(), 6),)], "mgmd double")


@_query("SELECT (SELECT count(*) FROM part) AS m, (SELECT count(*) FROM supplier) AS n, count(*) AS nnz FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)")
def matrix_query(spark, d):
    q = parts_by_suppliers(spark, d).query()
    return spark.createDataFrame([(q["m"], q["n"], q["nnz"])], "m long, n long, nnz long")


# --- sources and exports --------------------------------------------------------------------------


@_query(f"SELECT range AS i, 1 + coalesce((SELECT count(*) FROM ({_A}) a WHERE a.i < range), 0) AS ptr FROM range((SELECT count(*) + 1 FROM part))")
def export_csr_pointers(spark, d):
    return exports.csr(parts_by_suppliers(spark, d), 1)[0]


@_query(f"SELECT row_number() OVER (ORDER BY i, j) - 1 AS pos, j, v FROM ({_A})")
def export_csr(spark, d):
    return exports.csr(parts_by_suppliers(spark, d), 0)[1]


@_query(f"SELECT row_number() OVER (ORDER BY j, i) - 1 AS pos, i, v FROM ({_A})")
def export_csc(spark, d):
    return exports.csc(parts_by_suppliers(spark, d), 0)[1]


@_query(f"SELECT i, j, v FROM ({_A})")
def export_coo(spark, d):
    return exports.coo(parts_by_suppliers(spark, d))


@_query(f"SELECT s * 25 + n AS pos, coalesce(v, 0) AS v FROM (SELECT s_suppkey AS s FROM supplier), (SELECT range AS n FROM range(25)) LEFT JOIN ({_S}) q ON q.i = s AND q.j = n")
def export_dense(spark, d):
    return exports.dense(suppliers_by_nations(spark, d))


_BLOCKS = f"SELECT DISTINCT CAST(floor(i / 5) AS BIGINT) AS bi, CAST(floor(j / 5) AS BIGINT) AS bj FROM ({_S})"


@_query(
    f"""SELECT bi, bj, string_agg(CAST(CAST(coalesce(v, 0) AS INT) AS VARCHAR), ',' ORDER BY p) AS cells
FROM ({_BLOCKS}), (SELECT range AS p FROM range(25)) LEFT JOIN ({_S}) q ON q.i = bi * 5 + p // 5 AND q.j = bj * 5 + p % 5 GROUP BY bi, bj"""
)
def export_bsr_blocks(spark, d):
    b = exports.blocks(suppliers_by_nations(spark, d), 5)
    return b.select("bi", "bj", F.array_join(F.transform("values", lambda v: v.cast("int").cast("string")), ",").alias("cells"))


@_query(f"SELECT i, j, v FROM ({_S})")
def bsr_roundtrip(spark, d):
    s = suppliers_by_nations(spark, d)
    return builders.from_blocks(exports.blocks(s, 5, "col"), s.m, s.n, 5, "col").entries


@_query(f"SELECT i, j, v FROM ({_A})")
def csr_roundtrip(spark, d):
    a = parts_by_suppliers(spark, d)
    ptr, entries = exports.csr(a, 1)
    return builders.from_csr_tables(ptr, entries, a.m, a.n, index_base=1).entries


@_query("SELECT vec_id AS i, k - 1 AS j, CAST(embedding[k] AS DOUBLE) AS v FROM embeddings, (SELECT range AS k FROM range(1, 65)) WHERE embedding[k] <> 0")
def dense_rows_ingest(spark, d):
    e = _t(spark, d, "embeddings")
    return builders.from_rows(e, e.count(), 64, "vec_id", "embedding").entries


@_query(f"SELECT i, j, v FROM ({_R})")
def matrix_market_roundtrip(spark, d):
    tmp = Scratch(spark)
    path = f"{tmp.root}/returns.mtx"
    builders.write_matrix_market(returns(spark, d), path)
    tmp.expire()
    return builders.read_matrix_market(spark, path).entries


_HALF = "SELECT p_partkey AS i, p_partkey // 2 AS j, CAST(p_size AS DOUBLE) AS v FROM part"


def _half_file(spark: SparkSession, d: str, head: str, where: str = "true") -> str:
    """A Matrix Market file of every part: row p, column p / 2."""
    tmp, lines = Scratch(spark), _t(spark, d, "part").select(F.col("p_partkey").alias("i"), F.expr("p_partkey div 2").alias("j"), "p_size").where(where)
    n = _size(spark, d, "part")
    first = spark.createDataFrame([(0, f"%%MatrixMarket matrix coordinate {head}"), (1, f"{n} {n} {lines.count()}")], "o long, value string").coalesce(1).orderBy("o").select("value").coalesce(1)
    v = F.lit(None).cast("int") if head.startswith("pattern") else F.col("p_size")
    first.union(lines.select(F.concat_ws(" ", F.col("i") + 1, F.col("j") + 1, v))).write.text(f"{tmp.root}/half.mtx")
    tmp.expire()
    return f"{tmp.root}/half.mtx"


@_query(f"SELECT i, j, v FROM ({_HALF}) UNION ALL SELECT j AS i, i AS j, v FROM ({_HALF}) WHERE i <> j")
def matrix_market_symmetric(spark, d):
    return builders.read_matrix_market(spark, _half_file(spark, d, "integer symmetric")).entries


@_query(f"SELECT i, j, v FROM ({_HALF}) WHERE i <> j UNION ALL SELECT j AS i, i AS j, -v AS v FROM ({_HALF}) WHERE i <> j")
def matrix_market_skew(spark, d):
    return builders.read_matrix_market(spark, _half_file(spark, d, "real skew-symmetric", "i <> j")).entries


@_query(f"SELECT j AS i, i AS j, CAST(1 AS DOUBLE) AS v FROM ({_HALF})")
def matrix_market_pattern_upper(spark, d):
    return builders.read_matrix_market(spark, _half_file(spark, d, "pattern symmetric"), "upper").entries


@_query(f"SELECT i, j, v FROM ({_A})")
def csc_roundtrip(spark, d):
    a = parts_by_suppliers(spark, d)
    ptr, entries = exports.csc(a, 1)
    return builders.from_csc_tables(ptr, entries, a.m, a.n, index_base=1).entries


@_query(f"SELECT range AS j, coalesce((SELECT count(*) FROM ({_A}) a WHERE a.j < range), 0) AS ptr FROM range((SELECT count(*) + 1 FROM supplier))")
def export_csc_pointers(spark, d):
    return exports.csc(parts_by_suppliers(spark, d), 0)[0]


@_query(
    f"""SELECT CAST(row_number() OVER (ORDER BY bi, bj) AS BIGINT) - 1 AS pos, bj AS j, string_agg(CAST(CAST(coalesce(v, 0) AS INT) AS VARCHAR), ',' ORDER BY p) AS cells
FROM ({_BLOCKS}), (SELECT range AS p FROM range(25)) LEFT JOIN ({_S}) q ON q.i = bi * 5 + p // 5 AND q.j = bj * 5 + p % 5 GROUP BY bi, bj"""
)
def convert_to_bsr(spark, d):
    """The tables of a matrix converted to blocks: they have the size that the conversion gave."""
    _, cells = exports.tables(suppliers_by_nations(spark, d).convert("bsr", 5))
    return cells.select("pos", "j", F.array_join(F.transform("values", lambda v: v.cast("int").cast("string")), ",").alias("cells"))


@_query(f"SELECT range AS i, (SELECT count(*) FROM ({_BLOCKS}) q WHERE bi < range) AS ptr FROM range((SELECT count(*) // 5 + 1 FROM supplier))")
def export_bsr_pointers(spark, d):
    return exports.bsr(suppliers_by_nations(spark, d), 5)[0]


@_query(f"SELECT i, j, v FROM ({_A})")
def copy_outlives_destroy(spark, d):
    a = parts_by_suppliers(spark, d).optimize("spmv")
    b = a.copy()
    a.destroy()
    return b.entries


# --- vectors ------------------------------------------------------------------------------------------

_SPARSE = "SELECT s_suppkey AS i, CAST(s_suppkey % 7 AS DOUBLE) AS v FROM supplier WHERE s_suppkey % 7 <> 0"
_Y = "SELECT s_suppkey AS i, CAST(s_nationkey AS DOUBLE) AS v FROM supplier"


def _sparse(spark, d) -> vector.SparseVector:
    return vector.gather(supplier_vector(spark, d), _size(spark, d, "supplier"))


def _nations(spark, d) -> DataFrame:
    return _t(spark, d, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_nationkey").cast("double").alias("v"))


@_query(_SPARSE)
def gather(spark, d):
    return _sparse(spark, d).entries


@_query("SELECT s_suppkey + 1 AS i, CAST(s_nationkey AS DOUBLE) AS v FROM supplier WHERE s_nationkey > 3")
def vector_create(spark, d):
    """From a table with base 1, and exported in it."""
    e = _t(spark, d, "supplier").where("s_nationkey > 3").select((F.col("s_suppkey") + 1).alias("i"), F.col("s_nationkey").cast("double").alias("v"))
    return vector.from_table(e, _size(spark, d, "supplier"), index_base=1).export()


@_query(f"SELECT 0 AS index_base, (SELECT count(*) FROM supplier) AS n, (SELECT count(*) FROM ({_SPARSE})) AS nnz")
def vector_query(spark, d):
    q = _sparse(spark, d).query()
    return spark.createDataFrame([(q["index_base"], q["n"], q["nnz"])], "index_base int, n long, nnz long")


@_query(_X)
def scatter(spark, d):
    return _sparse(spark, d).scatter()


@_query(f"SELECT SUM(x.v * y.v) AS dot FROM ({_SPARSE}) x JOIN ({_Y}) y ON x.i = y.i")
def dot(spark, d):
    return spark.createDataFrame([(_sparse(spark, d).dot(_nations(spark, d)),)], "dot double")


@_query(f"SELECT SUM(x.v * y.v) AS re, SUM(-x.v * y.v) AS im FROM ({_SPARSE}) x JOIN ({_Y}) y ON x.i = y.i")
def dot_conjugate(spark, d):
    z = lambda df: df.select("i", F.struct(F.col("v").alias("re"), F.col("v").alias("im")).alias("v"))
    x = _sparse(spark, d)
    y = _nations(spark, d).select("i", F.struct(F.col("v").alias("re"), F.lit(0.0).alias("im")).alias("v"))
    got = vector.from_table(z(x.entries), x.n, "z").dot(y, conjugate=True)
    return spark.createDataFrame([(got.real, got.imag)], "re double, im double")


@_query(f"SELECT y.i, 2 * coalesce(x.v, 0) - y.v AS v FROM ({_Y}) y LEFT JOIN ({_SPARSE}) x ON x.i = y.i")
def axpby(spark, d):
    return _sparse(spark, d).axpby(2.0, -1.0, _nations(spark, d))


@_query(f"SELECT s_suppkey AS i, 3 * coalesce(x.v, 0) AS v FROM supplier LEFT JOIN ({_SPARSE}) x ON x.i = s_suppkey")
def waxpby(spark, d):
    return _sparse(spark, d).waxpby(3.0, 0.0, None)


@_query(f"SELECT y.i, CASE WHEN x.v IS NULL THEN y.v ELSE 0.5 * y.v - 2 * x.v END AS y, 0.5 * x.v + 2 * y.v AS x FROM ({_Y}) y LEFT JOIN ({_SPARSE}) x ON x.i = y.i")
def rot(spark, d):
    x, y = _sparse(spark, d).rot(_nations(spark, d), 0.5, 2.0)
    return y.withColumnRenamed("v", "y").join(x.entries.withColumnRenamed("v", "x"), "i", "left")


@_query(f"SELECT i, CASE WHEN i % 2 = 0 THEN -v ELSE v END AS v FROM ({_SPARSE})")
def vector_update(spark, d):
    x = _sparse(spark, d)
    return x.update(x.entries.where("i % 2 = 0").select("i", (-F.col("v")).alias("v"), F.lit(0).alias("pos"))).entries


# --- solves -----------------------------------------------------------------------------------------------
# Every lineitem row enters and rows grow with the tables. Recursion over so many rows is too slow in SQL: right-hand
# sides are made from known whole numbers and diagonals are twos, so a right solve gives those numbers back exactly.


def part_supplier_triangle(spark: SparkSession, d: str) -> SparseMatrix:
    """Quantities of parts (odd numbers) and suppliers (even ones), larger number by smaller, with twos on the diagonal: long chains of dependencies."""
    m = 2 * max(_size(spark, d, "part"), _size(spark, d, "supplier"))
    part, supplier = 2 * F.col("l_partkey") + 1, 2 * F.col("l_suppkey")
    low = _t(spark, d, "lineitem").select(F.greatest(part, supplier).alias("i"), F.least(part, supplier).alias("j"), F.col("l_quantity").alias("v"))
    return builders.from_table(low.unionByName(_twos(spark, m)), m, m)


def order_tiers(spark: SparkSession, d: str) -> SparseMatrix:
    """Suppliers, then parts, then orders: a part depends on its suppliers, an order on its parts and suppliers, by quantity."""
    ns, np = _size(spark, d, "supplier"), _size(spark, d, "part")
    m = ns + np + _size(spark, d, "orders")
    part, order = F.col("l_partkey") + ns, F.col("l_orderkey") + ns + np
    pairs = F.array(*[F.struct(a.alias("i"), b.alias("j")) for a, b in ((part, F.col("l_suppkey")), (order, part), (order, F.col("l_suppkey")))])
    low = _t(spark, d, "lineitem").select(F.explode(pairs).alias("e"), F.col("l_quantity").alias("v")).select("e.i", "e.j", "v")
    return builders.from_table(low.unionByName(_twos(spark, m)), m, m)


def _twos(spark: SparkSession, m: int) -> DataFrame:
    return spark.range(m).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(2.0).alias("v"))


def _known(spark: SparkSession, m: int) -> DataFrame:
    return spark.range(m).select(F.col("id").alias("i"), (F.col("id") % 5 + 1).cast("double").alias("v"))


_NT = "(SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders)"
_NP = "2 * greatest((SELECT count(*) FROM part), (SELECT count(*) FROM supplier))"
_KNOWN = "SELECT range AS i, CAST(range % 5 + 1 AS DOUBLE) AS v FROM range({})"


_SIDES = f"SELECT k.range AS rhs, r.range AS i, CAST(r.range * (k.range + 1) % 5 + 1 AS DOUBLE) AS v FROM range({{}}) k, range({_NT}) r"


def _sides(a: SparseMatrix, n: int, trans: str = "N") -> DataFrame:
    """Right-hand sides (rhs, i, v) that n known solutions give: of panels of columns, as the solves are."""
    e, out = a.op(trans).entries, None
    for lo in range(0, n, 32):
        ks = range(lo, min(lo + 32, n))
        sums = e.groupBy("i").agg(*[F.sum(F.col("v") * (F.col("j") * (k + 1) % 5 + 1)).alias(f"c{k}") for k in ks])
        part = sums.select("i", F.posexplode(F.array(*[f"c{k}" for k in ks])).alias("rhs", "v")).select((F.col("rhs") + lo).cast("long").alias("rhs"), "i", "v")
        out = part if out is None else out.unionByName(part)
    return out


@_query(_KNOWN.format(_NT))
def spsv(spark, d):
    a = order_tiers(spark, d)
    return solve.spsv(a, P.spmv(a, _known(spark, a.m)))


@_query(_KNOWN.format(_NT))
def spsv_trans(spark, d):
    a = order_tiers(spark, d)
    return solve.spsv(a, P.spmv(a, _known(spark, a.m), trans="T"), trans="T")


@_query(_KNOWN.format(_NT))
def spsv_upper(spark, d):
    a = order_tiers(spark, d).transpose()
    return solve.spsv(a, P.spmv(a, _known(spark, a.m)), method="levels")


@_query(_KNOWN.format(_NP))
def spsv_blocks(spark, d):
    a = part_supplier_triangle(spark, d)
    return solve.spsv(a, P.spmv(a, _known(spark, a.m)), method="blocks")


@_query(_KNOWN.format(_NT))
def spsv_optimized(spark, d):
    """Prepared once by the hinted strategy and operation, solved twice."""
    a = order_tiers(spark, d).hint("spsv_operation", "T").hint("spsv_strategy", "levels")
    ready = optimize.spsv_optimize(a)
    y = P.spmv(a, _known(spark, a.m), trans="T")
    # solutions are read from files, whose compressed size must not make them broadcast
    return solve.spsv(ready, solve.spsv(ready, y, 2.0).hint("merge").join(y.withColumnRenamed("v", "y"), "i").select("i", F.col("y").alias("v")))


@_query(_SIDES.format(64))
def spsm(spark, d):
    """64 right-hand sides, in panels."""
    a = order_tiers(spark, d)
    return solve.spsm(a, _sides(a, 64))


@_query(f"SELECT k.range AS rhs, r.range AS i, CAST(r.range * (k.range + 1) % 5 + 1 AS DOUBLE) AS v FROM range(8) k, range({_NP}) r")
def spsm_optimized(spark, d):
    """Prepared by blocks, solved for eight right-hand sides."""
    a = part_supplier_triangle(spark, d).hint("spsv_strategy", "blocks")
    return solve.spsm(optimize.spsm_optimize(a), _sides(a, 8))


_NL = "(SELECT count(*) FROM supplier) + (SELECT count(*) FROM orders) * (SELECT max(l_linenumber) FROM lineitem)"


def _lines(spark: SparkSession, d: str) -> tuple[DataFrame, int, int]:
    """(order, at, before, supplier, quantity) of every line: the rows of itself, the order's line before it (if any) and its supplier; the number of lines' rows; rows of an order."""
    lines = _t(spark, d, "lineitem")
    wide = lines.agg(F.max("l_linenumber")).first()[0]
    n = _size(spark, d, "orders") * wide
    at = F.col("l_orderkey") * wide + F.col("l_linenumber") - 1
    return lines.select(F.col("l_orderkey").alias("o"), at.alias("at"), F.when(F.col("l_linenumber") > 1, at - 1).alias("before"), (F.col("l_suppkey") + n).alias("supplier"), F.col("l_quantity").alias("v")), n, wide


def lines_and_suppliers(spark: SparkSession, d: str) -> tuple[SparseMatrix, DataFrame]:
    """Lines of orders, each on the line before it, in parts of 1,000 orders; suppliers, on all their lines, are the separator, part -1."""
    lines, n, wide = _lines(spark, d)
    m = n + _size(spark, d, "supplier")
    low = lines.select("supplier", "at", "v").unionAll(lines.where("before is not null").select("at", "before", "v")).toDF("i", "j", "v")
    parts = spark.range(m).select(F.col("id").alias("i"), F.when(F.col("id") < n, F.floor(F.col("id") / (1000 * wide))).otherwise(-1).cast("int").alias("part"))
    return builders.from_table(low.unionByName(_twos(spark, m)), m, m), parts


@_query(_KNOWN.format(_NL))
def spsv_parts(spark, d):
    a, parts = lines_and_suppliers(spark, d)
    y = P.spmv(a, _known(spark, a.m)).withColumn("rhs", F.lit(0).cast("long"))
    return solve.spsm_parts(a, parts, y, -1).select("i", "v")


@_query(f"SELECT k.range AS rhs, r.range AS i, CAST(r.range * (k.range + 1) % 5 + 1 AS DOUBLE) AS v FROM range(3) k, range({_NL}) r")
def spsm_parts(spark, d):
    """Several right-hand sides, the transposed matrix: the separator comes first."""
    a, parts = lines_and_suppliers(spark, d)
    return solve.spsm_parts(a, parts, _sides(a, 3, "T"), -1, trans="T")


@_query(
    f"""WITH w AS (SELECT max(l_linenumber) AS w, (SELECT count(*) FROM orders) * max(l_linenumber) AS n FROM lineitem),
l AS (SELECT l_orderkey * w + l_linenumber - 1 AS a, l_linenumber AS k, n + l_suppkey AS s, l_quantity AS v FROM lineitem, w)
SELECT i, j, SUM(v) AS v FROM (SELECT s AS i, a AS j, v FROM l UNION ALL SELECT a AS i, a - 1 AS j, v FROM l WHERE k > 1 UNION ALL SELECT range AS i, range AS j, CAST(2 AS DOUBLE) AS v FROM range({_NL})) GROUP BY i, j"""
)
def supernodal_create(spark, d):
    """The same matrix from supernodes: an order's lines share their rows and those lines' suppliers; a supplier is a supernode of its own."""
    lines, n, wide = _lines(spark, d)
    orders, m = n // wide, n + _size(spark, d, "supplier")
    own = spark.range(n).select(F.expr(f"id div {wide}").alias("s"), (F.col("id") % wide).alias("p"), F.col("id").alias("i"))
    alone = spark.range(n, m).select((F.col("id") - n + orders).alias("s"), F.lit(0).cast("long").alias("p"), F.col("id").alias("i"))
    # an order's suppliers come after its lines in its list
    nth = F.row_number().over(Window.partitionBy("s").orderBy("i"))
    other = lines.select(F.col("o").alias("s"), F.col("supplier").alias("i")).distinct().select("s", (nth + (wide - 1)).cast("long").alias("p"), "i")
    nodes = spark.range(orders).select(F.col("id").alias("s"), (F.col("id") * wide).alias("first"), (F.col("id") * wide + wide - 1).alias("last"), F.expr("int(id div 1000)").alias("part"))
    nodes = nodes.unionByName(alone.select("s", F.col("i").alias("first"), F.col("i").alias("last"), F.lit(-1).alias("part")))
    cells = lines.join(other.select(F.col("s").alias("o"), F.col("i").alias("supplier"), "p"), ["o", "supplier"]).select(F.col("at").alias("j"), "p", "v")
    cells = cells.unionByName(lines.where("before is not null").select(F.col("before").alias("j"), (F.col("at") % wide).alias("p"), "v"))
    twos = _twos(spark, m).select("j", F.when(F.col("j") < n, F.col("j") % wide).otherwise(0).alias("p"), "v")
    values = cells.unionByName(twos).groupBy("j", "p").agg(F.sum("v").alias("v"))
    a, _ = builders.from_supernodes(nodes, own.unionByName(alone).unionByName(other), values, m, m)
    return a.entries


@_query(
    """WITH s AS (SELECT count(*) AS n FROM supplier), p AS (SELECT count(*) AS n FROM part)
SELECT s_suppkey AS i, 0 AS level FROM supplier
UNION ALL SELECT s.n + p_partkey, CAST(p_partkey IN (SELECT l_partkey FROM lineitem) AS INT) FROM part, s
UNION ALL SELECT s.n + p.n + o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN 2 ELSE 0 END FROM orders, s, p"""
)
def solve_levels(spark, d):
    return solve.levels(order_tiers(spark, d))


@_query("SELECT CAST(range AS BIGINT) AS rhs, CAST(0 AS DOUBLE) AS absolute, CAST(0 AS DOUBLE) AS relative FROM range(4)")
def solve_residual(spark, d):
    a = order_tiers(spark, d)
    y = _sides(a, 4)
    return solve.residual(a, solve.spsm(a, y), y)


@_query("SELECT 'lower' AS shape, 'non_unit' AS diag")
def structure(spark, d):
    shape, diag = part_supplier_triangle(spark, d).structure()
    return spark.createDataFrame([(shape.value, diag.value)], "shape string, diag string")
