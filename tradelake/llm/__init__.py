"""Operators of a training-data pipeline: mixing, token files, decontamination, near-dedup,
token counts, line dedup, secret scan, nearest neighbours, quality and language scores.

Nothing else in the library imports this subpackage.
"""
