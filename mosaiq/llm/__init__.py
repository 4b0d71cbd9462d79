"""Operators for building training corpora at scale: mixing, deduplication,
token files, media columns, scoring, packing and sharding.

Nothing else in the library imports this subpackage.
"""
