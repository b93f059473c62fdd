"""Structured Streaming: ingest with sibling state for each key."""
