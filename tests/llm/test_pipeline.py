"""The pipeline on the small documents: every stage's decisions against what it should keep."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as cp
from sparseframe.llm.decontaminate import normal

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [len(cp.STAGES), cp.ORACLE_SQL] == [5, None]
    rows = {r["doc_id"]: r for r in docs.collect()}
    good = cp.quality(spark, docs, SF)
    assert good.columns == list(cp.COLUMNS)
    kept = {r["doc_id"]: r for r in good.collect()}
    assert 0 < len(kept) < len(rows) and all(kept[i] == rows[i] for i in kept)
    single = {r["doc_id"] for r in cp.near_duplicates(spark, good, SF).collect()}
    texts = Counter(r["text"] for r in kept.values())
    assert all(sum(i in single for i, r in kept.items() if r["text"] == t) <= 1 for t, n in texts.items() if n > 1)
    clean = cp.benchmark_leaks(spark, good, SF)
    left = {r["doc_id"] for r in clean.collect()}
    items = [normal(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert left == {i for i, r in kept.items() if not any(t in normal(r["text"]) for t in items)}
    safe = cp.personal_data(spark, clean, SF)
    assert safe.columns == list(cp.COLUMNS) and safe.where("text rlike '[a-z]@[a-z]'").count() == 0
    assert safe.where(F.length("text") != F.col("n_chars")).count() == 0
    out = cp.run(spark, SF)
    ids = {r["doc_id"] for r in out.select("doc_id").collect()}
    assert ids and ids <= single and ids <= left and out.where("n_tokens <> size(ids)").count() == 0


def test_pipeline_of_nothing_and_of_nulls(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    docs = spark.createDataFrame([(1, None, None, None, None), (None, None, None, None, None), (2, "", "en", "s", 0)], schema)
    for rows in (docs, docs.limit(0)):
        assert cp.quality(spark, rows, SF).collect() == []
        for _, stage in cp.STAGES[1:]:
            assert stage(spark, rows, SF).count() == rows.count()


def test_repeated_and_unnamed_rows_stay_once(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    text = {k: " ".join(f"{k}{i}" for i in range(30)) for k in "abcdef"}
    rows = [(5, "a"), (5, "a"), (3, "b"), (3, "b"), (4, "b"), (4, "b"), (None, "c"), (None, "c"), (None, "a"), (7, "d"), (8, "e"), (8, "f")]
    docs = spark.createDataFrame([(i, text[k], "en", f"s{n}", len(text[k])) for n, (i, k) in enumerate(rows)] + [(9, "", "en", "s", 0), (10, "", "en", "s", 0), (None, "", "en", "s", 0)], schema)
    got = Counter((r["doc_id"], r["text"], r["source"]) for r in cp.near_duplicates(spark, docs, SF).collect())
    want = [(5, "a", 0), (3, "b", 2), (None, "c", 6), (7, "d", 9), (8, "e", 10), (8, "f", 11)]
    assert got == Counter([(i, text[k], f"s{n}") for i, k, n in want] + [(9, "", "s"), (10, "", "s"), (None, "", "s")])
