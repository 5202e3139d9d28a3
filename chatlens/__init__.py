"""Batch and streaming analytics over labelled live-chat messages, on PySpark."""
