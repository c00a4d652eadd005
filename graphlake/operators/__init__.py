"""Operators on graph rows: traversal, sibling alignment, uniqueness, text search, mutation."""
