"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its general interface; ``queries`` holds the thin registered
queries that apply the operators to whole tables.
"""
