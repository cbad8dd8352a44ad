"""Scalar arithmetic on value columns, real and complex."""
