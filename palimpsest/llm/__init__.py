"""Training-data operators: quality, deduplication, sharding, mixing, safety and search.

Nothing else in :mod:`palimpsest` imports this subpackage.
"""
