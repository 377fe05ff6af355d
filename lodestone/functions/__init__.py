"""Scalar functions and the arithmetic compiler, all as Column expressions."""
