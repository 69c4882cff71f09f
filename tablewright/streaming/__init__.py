"""Incremental forms of the batch work."""
