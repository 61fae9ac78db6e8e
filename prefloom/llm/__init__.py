"""Training-data operators: thirteen corpus operators and the queries that apply them.

Nothing outside this package imports it.  `queries.py` holds the registered
queries and `oracle.py` their DuckDB SQL.
"""
