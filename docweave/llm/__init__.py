"""Operators for large text corpora: cleaning, de-duplication, mixing, scoring, tokenising and packing.

Nothing else in the library imports this subpackage; it can be removed as a whole.
"""
