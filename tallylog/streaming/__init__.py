"""Resumable ingest with Structured Streaming."""
