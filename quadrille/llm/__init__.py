"""Operators for preparing training data: dedup, scoring, tokenising, packing, archives."""
