"""Whole scans and report documents."""
