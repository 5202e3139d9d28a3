"""Operators for language-model training data: filtering, dedup, scans, counting, packing."""
