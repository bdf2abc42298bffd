"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  Each ``opN`` module holds one
operator with a general interface plus the thin query that the entry module
registers; ``registry`` gathers the queries and their oracle SQL.
"""
