"""Readers and the test views derived from the given tables."""
