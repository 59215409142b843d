"""Queries over the given tables, built from the operators."""
