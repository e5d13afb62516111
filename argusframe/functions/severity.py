"""Severity scale and the scales of the external tools."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Order, weights and multipliers of the score.
SEVERITIES = ("critical", "high", "medium", "low")
SEVERITY_WEIGHT = {"critical": "20", "high": "10", "medium": "4", "low": "1"}
CATEGORY_MULTIPLIER = {"secret": "1.5", "code": "1.0", "config": "0.8", "dependency": "0.9", "web": "1.0"}


def _lookup(value: Column, table: dict[str, str], default: Column) -> Column:
    chain = None
    for key, out in table.items():
        chain = F.when(value == key, F.lit(out)) if chain is None else chain.when(value == key, F.lit(out))
    return chain.otherwise(default)


def severity_rank(severity: Column) -> Column:
    """1 for critical to 4 for low; null for anything else."""
    return _lookup(severity, {s: i for i, s in enumerate(SEVERITIES, 1)}, F.lit(None).cast("int"))


def severity_weight(severity: Column) -> Column:
    return _lookup(severity, SEVERITY_WEIGHT, F.lit("1")).cast("decimal(4,1)")


def category_multiplier(category: Column) -> Column:
    return _lookup(category, CATEGORY_MULTIPLIER, F.lit("1.0")).cast("decimal(4,1)")


def semgrep_severity(value: Column) -> Column:
    return _lookup(F.upper(value), {"ERROR": "high", "WARNING": "medium", "INFO": "low"}, F.lit("medium"))


def trivy_severity(value: Column) -> Column:
    return _lookup(F.upper(value), {"CRITICAL": "critical", "HIGH": "high", "MEDIUM": "medium"}, F.lit("low"))


def npm_severity(value: Column) -> Column:
    return _lookup(value, {"critical": "critical", "high": "high", "moderate": "medium"}, F.lit("low"))
