"""Operators for large-scale training-data preparation.

Nothing else in the library imports this subpackage. ``queries.py`` holds the
thin registered queries, ``oracle.py`` their DuckDB twins.
"""
