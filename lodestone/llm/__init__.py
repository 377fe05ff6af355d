"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; ``queries.py`` holds the driver-facing
queries and their oracle SQL.
"""
