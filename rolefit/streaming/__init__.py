"""Structured Streaming jobs: incremental ingest and daily counts."""
