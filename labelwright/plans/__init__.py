"""Whole pipelines, and the queries over the driver's tables."""
