"""Readers, writers and small tables made in code."""
