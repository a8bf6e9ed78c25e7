"""Scalar functions: how source values become terms."""
