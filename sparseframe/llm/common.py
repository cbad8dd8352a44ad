"""Session helpers shared by the operators: tables, shared scratch space, bounded Arrow batches."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import Scratch, input_bytes, shared_dir

__all__ = ["SPACES", "Scratch", "bounded_batches", "clean_name", "crc_mod4", "input_bytes", "kept_columns", "shared_dir", "sliced", "table", "tidy", "without"]

#: ASCII white space, as the contracts' word pattern [^\x20\x09-\x0D]+ leaves it out.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most `limit` bytes in `column`, of one row at least, so that temporary arrays stay bounded."""
    if not len(batch):
        return
    at = batch.schema.get_field_index(column)
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    yield batch.slice(start)


def tidy(run):
    """run, for mapInArrow: when a task's batches are done, memory that its worker holds without using it goes back to the system."""

    @functools.wraps(run)
    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim:
            trim(0)

    return tidied


def crc_mod4(doc_id):
    """crc32 of the id as text, modulo 4, as a column."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def clean_name(name: str, taken) -> str:
    """A column name that clashes with none of `taken`, whatever their case."""
    taken = {n.lower() for n in taken}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without(df: DataFrame, names) -> DataFrame:
    """Drops input columns that clash with an operator's output columns, whatever their case."""
    return df.select(*[F.col(f"`{c}`") for c in kept_columns(df, df.columns, names)])


def kept_columns(df: DataFrame, keep, outputs) -> list[str]:
    """The columns of `keep` but those that clash with an output's name, whatever their case."""
    low = {n.lower() for n in outputs}
    return [c for c in keep if c.lower() not in low]


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1,000 rows and 4 MB (one row at least), and columnar batches of 512 rows from Parquet, unless the session says otherwise: rows are texts of any length."""
    for key, value in (("execution.arrow.maxRecordsPerBatch", "1000"), ("execution.arrow.maxBytesPerBatch", str(4 << 20)), ("parquet.columnarReaderBatchSize", "512")):
        if spark.conf.get(f"spark.sql.{key}", None) is None:
            spark.conf.set(f"spark.sql.{key}", value)
