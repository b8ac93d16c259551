"""Training-data operators.  Nothing else in the library imports this subpackage.

Each ``opN_*`` module holds a general operator, the thin ``query`` that applies
it to a whole table with production parameters, and ``ORACLE_SQL`` where DuckDB
can express the same rows.
"""
