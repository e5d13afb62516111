"""Detectors and aggregations, DataFrame to DataFrame."""
