"""Whole jobs: the dashboard, a summary run, a label correction, table writes."""
