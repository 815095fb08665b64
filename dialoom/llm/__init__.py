"""Operators for training data: sampling, near duplicates, pair defects, tokens, mixing, text quality.

Nothing outside this package imports it.
"""
