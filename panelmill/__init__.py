"""Weighted-panel analytics written with the Spark DataFrame API."""

__version__ = "0.1.0"
