"""Relational operators of retrieval, ingestion and management; DataFrame in, DataFrame out."""
