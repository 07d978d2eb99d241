"""Structured Streaming: incremental ingest and windowed check-in counts."""
