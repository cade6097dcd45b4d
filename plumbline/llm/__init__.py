"""Operators of a training-data pipeline: deduplication, filtering, scoring, formatting and packing of texts.

Nothing outside this package imports it; ``queries`` holds its registered queries.
"""
