"""Incremental ingest and conversation memory on Structured Streaming."""
