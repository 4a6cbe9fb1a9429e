"""Corpus preparation for language-model training: fingerprints, search, tokens, filters, privacy, packing.

Nothing outside this subpackage imports it.
"""
