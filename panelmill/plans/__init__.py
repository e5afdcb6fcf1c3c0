"""Recipes that compose the operators into whole analyses."""
