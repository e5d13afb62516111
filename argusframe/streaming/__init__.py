"""Structured Streaming jobs over the batch transformations."""
