"""Sparse linear algebra over DataFrames of (i, j, v) entries."""
