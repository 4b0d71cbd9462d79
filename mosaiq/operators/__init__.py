"""Relational operators of mosaicking: matching, gates, layout graphs, evaluation, canvas."""
