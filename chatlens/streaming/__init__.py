"""Structured Streaming forms of ingest, timeline and label write-back."""
