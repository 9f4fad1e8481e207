"""Operators of a training-data pipeline: sharding, scoring, packing, cleaning and deduplication.

Nothing else in the library imports this subpackage.
"""
