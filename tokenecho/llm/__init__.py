"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage; queries and their SQL are
in :mod:`tokenecho.llm.queries`.
"""
