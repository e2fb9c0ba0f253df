"""Structured Streaming forms of ingest, daily series and monitors."""
