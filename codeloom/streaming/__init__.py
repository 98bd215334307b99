"""Incremental issue processing with Structured Streaming."""
