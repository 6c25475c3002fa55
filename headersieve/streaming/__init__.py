"""Structured Streaming: ingest and verdicts."""
