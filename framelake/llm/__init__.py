"""Operators for training-data pipelines (search, dedup, filtering, tokenising).

Nothing outside this subpackage imports it; ``queries.py`` holds the thin
contract queries and ``sql.py`` their SQL.
"""
