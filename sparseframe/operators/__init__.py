"""Matrices, vectors, products, norms and solves."""
