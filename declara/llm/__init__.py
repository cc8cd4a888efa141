"""Training-data operators: one module each, plus the queries that apply them.

Nothing else in the library imports this subpackage.
"""
