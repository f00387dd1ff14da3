"""Operators for large training corpora: tokens, overlap, filters and dedup.

Nothing outside this subpackage imports it.
"""
