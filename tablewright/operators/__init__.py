"""Relational operators around plans: catalog, windows, retrieval, evaluation, gates, bounded execution."""
