"""Incremental versions of the aggregates, on Structured Streaming."""
