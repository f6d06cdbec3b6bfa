"""Training-data operators: quality, packing, sharding, fingerprints, deduplication, scans.

Nothing else in the library imports this subpackage.
"""
