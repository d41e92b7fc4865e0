"""Operators for large text corpora: fingerprints, archives, scoring, mixing, filtering, tokens, search."""
