"""Structured Streaming faces of the pipelines."""
