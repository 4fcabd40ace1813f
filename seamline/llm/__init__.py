"""Operators for large training corpora: deduplication, mixing, scoring, packing, archives."""
