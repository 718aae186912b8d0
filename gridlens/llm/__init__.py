"""Operators for preparing training data: dedup, decontamination, scoring, mixing, sharding, search."""
