"""Operators for large training-data pipelines, one module per operator.

Nothing else in the package imports this subpackage; it can be deleted whole.
``catalog.py`` lists the queries, each operator module holds its general interface
and the thin query that derives the digest columns.
"""
