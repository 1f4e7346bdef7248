"""Operators for training-data pipelines over tables of documents.

Nothing outside this subpackage imports it; ``queries.py`` holds what the
driver entry registers.
"""
