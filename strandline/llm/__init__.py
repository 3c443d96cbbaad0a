"""Operators for preparing training text at scale.

Nothing else in the package imports this subpackage.  Each operator module has
a general interface on DataFrames; ``queries`` holds the thin registered
queries on the standard tables.
"""
