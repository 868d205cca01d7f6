"""Structured Streaming forms of ingest, usage windows and alerts (an extension)."""
