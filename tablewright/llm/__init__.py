"""Corpus operations for training-data pipelines: deduplication, tokens, search, filters.

Nothing outside this folder imports it.  Documents are rows (doc_id, text, ...); each module says
what its operator does with nulls, empty texts, repeated rows and empty tables.
"""
