"""Structured Streaming ingestion of facts."""
