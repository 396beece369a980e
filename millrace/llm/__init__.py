"""Training-data operators.

Nothing outside this package imports it; ``queries.py`` holds the registered
queries and ``sql.py`` their DuckDB counterparts.
"""
