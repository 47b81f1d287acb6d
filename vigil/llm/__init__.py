"""Operators of a training-data pipeline: search, packing, deduplication, token files, filters and mixing.

Nothing else in the library imports this subpackage.
"""
