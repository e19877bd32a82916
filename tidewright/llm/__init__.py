"""Operators that prepare text corpora for language-model training.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""
