"""Corpus preparation: packing, filtering, cleaning, scoring and deduplication of training text.

Nothing else in the library imports this subpackage.
"""
