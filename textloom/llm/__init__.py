"""Operators for large training-data pipelines.

Nothing outside this package imports it.  Queries and their SQL live in
``textloom.llm.queries``; every other module holds one operator.
"""
