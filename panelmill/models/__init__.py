"""Regressions whose data passes are Spark aggregations."""
