"""Structured Streaming jobs: incremental ingest and incremental annual masks."""
