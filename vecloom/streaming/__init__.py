"""Structured Streaming forms of the profiling aggregates."""
