"""Readers: archives, tables, external reports, earlier results."""
