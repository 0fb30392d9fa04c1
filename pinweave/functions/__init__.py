"""Scalar and statistical helpers."""
