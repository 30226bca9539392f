"""Structured Streaming ingest, incremental counts and refit."""
