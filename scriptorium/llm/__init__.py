"""Operators for preparing training text: deduplication, scoring, packing, encoding.

Nothing else in the library imports this package; it may be removed as a whole.
"""
