"""Merge plans, lineage views and the query catalogue."""
