"""Incremental forms of the metrics over event streams."""
