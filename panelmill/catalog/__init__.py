"""Registered queries over the driver tables, each with its SQL twin where one exists."""

from panelmill.catalog.registry import ORACLE, QUERIES, load_all

__all__ = ["ORACLE", "QUERIES", "load_all"]
