"""Operators for preparing text corpora (training-data pipelines).

Nothing else in the library imports this subpackage; ``registry`` holds its
queries and their SQL.
"""
