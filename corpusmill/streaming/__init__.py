"""Structured Streaming: ingestion, progress, in-flight duplicates, idle sessions."""
