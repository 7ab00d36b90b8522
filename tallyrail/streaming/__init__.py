"""Incremental ingestion of result rows with Structured Streaming."""
