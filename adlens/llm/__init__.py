"""Operators of a training-data pipeline and their registered queries.

Nothing else in the library imports this subpackage.
"""
