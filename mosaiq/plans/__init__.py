"""Queries over the given tables, each an operator on an analogous relation."""
