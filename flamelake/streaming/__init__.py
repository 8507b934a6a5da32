"""Structured Streaming forms of ingest, range rollups and the upload lifecycle."""
