"""Operators over text corpora: scans, deduplication, tokenisation and quality rules.

Nothing else in the library imports this subpackage; the package works without it.
"""
