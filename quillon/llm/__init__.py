"""Operators for preparing large training corpora: tokens, near-duplicates, filters, mixing, archives."""
