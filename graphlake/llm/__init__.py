"""Operators for building training data: scans, filters, de-duplication, mixing.

Nothing outside this subpackage imports it.  Every operator takes a DataFrame with at least ``doc_id`` and
``text``; names, results for nulls, empty texts, ties and repeated rows stand in each operator's docstring.
"""
