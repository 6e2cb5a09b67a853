"""Operators for preparing training data; nothing else in the library imports this folder.

Rows that share a doc_id are one document repeated. A null text is an empty one.
"""
