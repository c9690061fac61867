"""Operators for preparing training text: deduplication, mixing, sharding, filtering, encoding.

Nothing else in the library imports this subpackage.
"""
