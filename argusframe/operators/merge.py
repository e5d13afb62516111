"""Putting scanner outputs together."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from argusframe.functions.severity import SEVERITIES, severity_rank
from argusframe.operators.deps import LOCK_FILES, PACKAGE_MANIFEST, REQUIREMENTS, scan_manifests
from argusframe.schema import FINDING_COLUMNS, as_findings
from argusframe.session import write_down
from argusframe.sources.reports import parse_reports, read_npm_audit_report, read_trivy_report

# Result order of findings inside a target; files by path.
EMISSION_ORDER = ("scanner_ord", "file", "rule_ord", "seq", "line", "rule_id", "title", "description", "severity")

# Dependency sources, best first.
SOURCE_RANK = {"trivy": 1, "npm-audit": 2}


def union_scanners(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [p if p.columns == FINDING_COLUMNS else as_findings(p) for p in parts])


def filter_severity(findings: DataFrame, threshold: str = "low") -> DataFrame:
    """Findings at or above the threshold; unknown severities always drop."""
    if threshold not in SEVERITIES:
        raise ValueError(f"unknown severity {threshold!r}; one of {', '.join(SEVERITIES)}")
    return findings.filter(F.col("severity").isin(*SEVERITIES[: SEVERITIES.index(threshold) + 1]))


def dedup_findings(findings: DataFrame) -> DataFrame:
    """First finding per target, file, line and rule (or title). The ranking
    filter lets Spark keep one row per key and task before the shuffle, so
    many copies of one finding do not meet in one task."""
    key = F.coalesce(F.when(F.col("rule_id") != "", F.col("rule_id")), F.col("title"))
    window = Window.partitionBy("target_id", "file", "line", "_key").orderBy("scanner_ord", "rule_ord", "seq", "title", "description")
    return (
        findings.withColumn("_key", key).withColumn("_rn", F.row_number().over(window))
        .filter(F.col("_rn") == 1).drop("_key", "_rn")
    )


def best_sources(files: DataFrame, reports: DataFrame) -> DataFrame:
    """``(target_id, best)`` where ``best`` is the rank of the first dependency
    source that succeeded: a readable Trivy report, a readable npm report of a
    target with a package-lock.json, else the built-in checks. Targets on the
    built-in checks are left out."""
    readable = F.col("readable") if "readable" in reports.columns else F.try_parse_json("json").isNotNull()
    have = reports.filter(F.col("source").isin("trivy", "npm-audit") & readable).select(
        "target_id", (F.col("source") == "trivy").alias("trivy"), (F.col("source") == "npm-audit").alias("npm"), F.lit(False).alias("locked"))
    locks = files.filter(F.col("path") == "package-lock.json").select(
        "target_id", F.lit(False).alias("trivy"), F.lit(False).alias("npm"), F.lit(True).alias("locked"))
    best = F.when(F.max("trivy"), SOURCE_RANK["trivy"]).when(F.max("npm") & F.max("locked"), SOURCE_RANK["npm-audit"])
    return have.unionByName(locks).groupBy("target_id").agg(best.alias("best")).filter(F.col("best").isNotNull())


def source_cascade(files: DataFrame, reports: DataFrame) -> DataFrame:
    """Dependency findings of each target's best source only; a source that
    succeeded with nothing found still silences the later ones. Reports and
    manifests are chosen before they are taken apart into findings, while they
    are a few rows per target. Reports are parsed once and written down parsed, in columns, and so is the choice, since every branch
    asks for both."""
    parsed = write_down(parse_reports(reports.filter(F.col("source").isin(*SOURCE_RANK))))
    best = write_down(best_sources(files, parsed))
    chosen = parsed.join(best, "target_id").filter(
        ((F.col("source") == "trivy") & (F.col("best") == SOURCE_RANK["trivy"]))
        | ((F.col("source") == "npm-audit") & (F.col("best") == SOURCE_RANK["npm-audit"])))
    manifests = files.filter(F.col("path").isin(PACKAGE_MANIFEST, REQUIREMENTS, *LOCK_FILES))
    left = manifests.join(best, "target_id", "left_anti")
    return union_scanners([read_trivy_report(chosen), read_npm_audit_report(chosen), scan_manifests(left)])


def order_by_severity(findings: DataFrame) -> DataFrame:
    return findings.orderBy("target_id", severity_rank(F.col("severity")), *EMISSION_ORDER)


def emission_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy("target_id", *EMISSION_ORDER)
