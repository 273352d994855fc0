"""Operators for large-scale text corpora: packing, deduplication, encoding, scoring, scanning and sharding.

Nothing else in the library imports this subpackage.
"""
