"""Operators for training-data pipelines.

One module for each operator, over the tables documents, pages and
embeddings; ``queries`` registers one query for each.  Nothing outside this
subpackage imports it.
"""
