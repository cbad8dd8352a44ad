"""Operator calls at $BENCH_SF_DIR on local[$BENCH_CPUS], on operands made and kept beforehand: one warm-up, then the median of three runs. Prints one JSON line; what making the operands took stands apart, under "prepared"."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
# Python workers look for the package there too, wherever this is started
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, *filter(None, [os.environ.get("PYTHONPATH")])])

RUNS = int(os.environ.get("BENCH_RUNS", "3"))
#: Right-hand sides of the solve with many of them.
SIDES = int(os.environ.get("BENCH_SIDES", "64"))


def kept(df: DataFrame) -> DataFrame:
    df = df.persist()
    df.count()
    return df


def calls(spark: SparkSession, d: str, prepared: dict) -> dict:
    from sparseframe import catalog as C
    from sparseframe.operators import optimize, solve
    from sparseframe.operators import products as P
    from sparseframe.operators.matrix import SparseMatrix
    from sparseframe.sources import builders, exports

    def made(name: str, f):
        began = time.time()
        x = f()
        if isinstance(x, SparseMatrix):
            x = SparseMatrix(kept(x.entries), x.meta)
        elif isinstance(x, DataFrame):
            x = kept(x)
        prepared[name] = round(time.time() - began, 3)
        return x

    a = made("parts_by_suppliers", lambda: C.parts_by_suppliers(spark, d))
    r = made("returns", lambda: C.returns(spark, d))
    s = made("suppliers_by_nations", lambda: C.suppliers_by_nations(spark, d))
    mask = made("sample_pattern", lambda: C.sample_pattern(spark, d))
    xs, xp = made("supplier_vector", lambda: C.supplier_vector(spark, d)), made("part_vector", lambda: C.part_vector(spark, d))
    wide = made("dense_rows", lambda: spark.range(a.n).select(F.col("id").alias("i"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: ((F.col("id") + k) % 5).cast("double")).alias("values")))
    e = made("embedding_rows", lambda: C._t(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").alias("values")))
    n = e.count()
    near = e.select("i", F.explode(F.array(F.lit(1), F.lit(7), F.lit(31))).alias("s")).select("i", ((F.col("i") + F.col("s")) % n).alias("j"), F.lit(1.0).alias("v"))
    pairs = made("embedding_pairs", lambda: builders.from_table(near, n, n, duplicates="unique"))
    changes = made("changes", lambda: r.entries.select("i", "j", (-F.col("v")).alias("v"), F.lit(0).alias("pos")))
    tiers = made("order_tiers", lambda: C.order_tiers(spark, d))
    ready = made("spsv_optimize", lambda: optimize.spsv_optimize(tiers))
    y1 = made("one_side", lambda: P.spmv(tiers, C._known(spark, tiers.m)))
    ys = made(f"{SIDES}_sides", lambda: C._sides(tiers, SIDES))
    chain = made("part_supplier_triangle", lambda: C.part_supplier_triangle(spark, d))
    blocks = made("spsv_optimize_blocks", lambda: optimize.spsv_optimize(chain, "blocks"))
    yb = made("one_side_of_blocks", lambda: P.spmv(chain, C._known(spark, chain.m)))
    sparse = C._sparse(spark, d)
    return {
        "spmv": lambda: P.spmv(a, xs),
        "spmv_trans": lambda: P.spmv(a, xp, trans="T"),
        "spmm": lambda: P.spmm(a, s).entries,
        "spmm_self": lambda: P.spmm(r, r, trans_a="T").entries,
        "spmm_dense_rows": lambda: P.spmm_rows(a, wide, 64),
        "spadd": lambda: P.spadd(a, r, 2.0, -1.0).entries,
        "spelmm": lambda: P.spelmm(a, r).entries,
        "sddmm": lambda: P.sddmm(a, s, mask).entries,
        "sddmm_dense_rows": lambda: P.sddmm_rows(e, e.withColumnRenamed("i", "j"), pairs).entries,
        "transpose": lambda: a.transpose().entries,
        "norm_inf": lambda: P.norm_inf(a),
        "norm_frobenius": lambda: P.norm_frobenius(a),
        "update": lambda: a.update(changes),
        "export_csr": lambda: exports.csr(a, 0)[1],
        "spsv": lambda: solve.spsv(ready, y1),
        "spsm": lambda: solve.spsm(ready, ys),
        "spsv_blocks": lambda: solve.spsv(blocks, yb),
        "dot": lambda: sparse.dot(xs),
    }


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from sparseframe.operators.matrix import SparseMatrix

    seconds, prepared = {}, {}
    for name, call in calls(spark, d, prepared).items():
        took = []
        for k in range(RUNS + 1):
            began = time.time()
            out = call()
            rows = out.entries if isinstance(out, SparseMatrix) else out
            if isinstance(rows, DataFrame):
                rows.write.format("noop").mode("overwrite").save()
            if k or not RUNS:
                took.append(time.time() - began)
            if isinstance(out, SparseMatrix):
                out.destroy()
        seconds[name] = round(statistics.median(took), 3)
    print(json.dumps({"metric": "operator calls on prepared operands, sum of medians", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "prepared": prepared, "sf": d.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
