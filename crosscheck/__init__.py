"""Inputs derived from the driver's tables, Spark queries over them and plain
SQL that states the same results independently."""
