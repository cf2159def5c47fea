"""Operators of a training-data pipeline (deduplication, scans, packing, scoring).

Nothing outside this subpackage imports it.
"""
