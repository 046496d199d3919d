"""Operators for large text corpora: deduplication, filtering, scanning, formatting and packing.

Nothing outside this folder imports it. Every operator takes DataFrames and returns
DataFrames; the fixed-shape queries built from them are in ``queries``.
"""
