"""Operators for preparing text corpora at cluster scale.

Nothing else in the library imports this subpackage. Each module holds one
operator with its own general interface; ``queries`` binds them to the tables.
"""
