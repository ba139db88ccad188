"""Relational operators over batches and snapshots."""
