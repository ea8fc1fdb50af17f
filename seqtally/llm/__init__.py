"""Training-data operators: sharding, packing, dedup, filters and token files.

Nothing else in the library imports this subpackage.
"""
