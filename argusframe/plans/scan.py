"""A whole scan as one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from argusframe.functions.urls import classify_target
from argusframe.operators.deps import manifest_errors, scan_manifests
from argusframe.operators.files import MAX_SCAN_BYTES
from argusframe.operators.merge import dedup_findings, filter_severity, source_cascade, union_scanners
from argusframe.operators.rules import AI_RULES, RULES, Rule, prune_rules
from argusframe.operators.sast import env_not_ignored, match_rule_table, report_rules
from argusframe.operators.score import score_targets
from argusframe.operators.secrets import SECRET_RULES, report_secrets
from argusframe.operators.syntax import scan_syntax
from argusframe.operators.web import scan_web, web_errors
from argusframe.plans.evidence import file_evidence, new_evidence_path, read_evidence, remove_folder, write_evidence
from argusframe.schema import FINDINGS
from argusframe.sources.reports import read_semgrep_report


@dataclass
class ScanOptions:
    """What to run and what to keep. ``semgrep_root`` is cut from the paths of
    code reports; files over ``max_bytes`` (null: none) are left out by the code
    rules and listed in ``errors``; ``syntax`` adds the shipped syntax rules, which read the files once more."""
    secrets: bool = True
    deps: bool = True
    sast: bool = True
    web: bool = True
    min_severity: str = "low"
    rules: list[Rule] = field(default_factory=lambda: RULES)
    rule_table: DataFrame | None = None
    semgrep_root: str = ""
    max_bytes: int | None = MAX_SCAN_BYTES
    syntax: bool = False


def with_scan_type(targets: DataFrame) -> DataFrame:
    """``targets`` with its ``scan_type`` (from ``target`` if absent)."""
    if "scan_type" in targets.columns:
        return targets
    return targets.withColumn("scan_type", classify_target(F.col("target")))


_ERRORS = "target_id string, scanner string, error string"


class Engine:
    """Scans tables of targets.

    ``files``, ``responses`` and ``reports`` are tables over many targets; any
    may be left out. Files are read once: what the scanners need from them is
    written to the checkpoint folder on first use, and findings, targets, file
    counts and errors all start from there. What needs a job to plan (that
    table, the web findings, the choice of reports) is made once and kept. ``close`` removes the table.

    ``evidence`` continues from tables written before instead of ``files``.
    """

    def __init__(self, files: DataFrame | None = None, responses: DataFrame | None = None,
                 reports: DataFrame | None = None, targets: DataFrame | None = None,
                 options: ScanOptions | None = None, evidence: DataFrame | None = None):
        self.files, self.responses, self.reports = files, responses, reports
        self.options = options or ScanOptions()
        self._targets = targets
        self._evidence = evidence
        self._path: str | None = None
        self._kept: dict[str, DataFrame] = {}

    @property
    def has_files(self) -> bool:
        return self.files is not None or self._evidence is not None

    @property
    def spark(self) -> SparkSession:
        for table in (self.files, self._evidence, self.responses, self.reports, self._targets):
            if table is not None:
                return table.sparkSession
        return SparkSession.active()

    def _keep(self, name: str, make) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = make()
        return self._kept[name]

    def close(self) -> None:
        """Remove the evidence this engine wrote; its results can't be read after that."""
        if self._path is not None:
            remove_folder(self.spark, self._path)
            self._path, self._evidence = None, None

    @property
    def broken(self) -> DataFrame:
        """Targets whose archive could not be read to its end."""
        return self._of_kind("broken").select("target_id").distinct()

    @property
    def targets(self) -> DataFrame:
        """``(target_id, scan_type)``; every target of the inputs if none were
        named. Targets with a broken archive are left out."""
        if self._targets is not None:
            named = with_scan_type(self._targets).select("target_id", "scan_type")
            return named.join(self.broken, "target_id", "left_anti") if self.has_files else named
        parts = []
        if self.has_files:
            whole = self._of_kind("file").select("target_id").distinct().join(self.broken, "target_id", "left_anti")
            parts.append(whole.select("target_id", F.lit("code").alias("scan_type")))
        if self.responses is not None:
            parts.append(self.responses.select("target_id", F.lit("web").alias("scan_type")).distinct())
        if not parts:
            return self.spark.createDataFrame([], "target_id string, scan_type string")
        targets = parts[0]
        for part in parts[1:]:
            targets = targets.unionByName(part)
        return targets.groupBy("target_id").agg(F.min("scan_type").alias("scan_type"))

    def plan_evidence(self) -> DataFrame:
        """The evidence as a plan over the files, not written."""
        options = self.options
        rules = prune_rules(options.rules, options.min_severity) if options.sast else []
        secrets = prune_rules(SECRET_RULES, options.min_severity) if options.secrets else []
        return file_evidence(self.files, rules, secrets, options.max_bytes)

    @property
    def evidence(self) -> DataFrame:
        if self._evidence is None:
            self._path = new_evidence_path(self.spark)
            write_evidence(self.plan_evidence(), self._path)
            self._evidence = read_evidence(self.spark, self._path)
        return self._evidence

    def _of_kind(self, kind: str) -> DataFrame:
        return self.evidence.filter(F.col("kind") == kind)

    @property
    def root_files(self) -> DataFrame:
        return self._of_kind("root").select("target_id", "path", "size_bytes", "content")

    def secret_findings(self) -> DataFrame:
        return report_secrets(self._of_kind("secret").select("target_id", "path", "rule_ord", "line", "seq", "secret"))

    def dependency_findings(self) -> DataFrame:
        if self.reports is None:
            return scan_manifests(self.root_files)
        return self._keep("dependencies", lambda: source_cascade(self.root_files, self.reports))

    def code_findings(self) -> DataFrame:
        options = self.options
        hits = self._of_kind("rule").select("target_id", "path", "rule_ord", "line")
        parts = [env_not_ignored(self.root_files), report_rules(hits, options.rules)]
        if options.rule_table is not None:
            if self.files is None:
                raise ValueError("a rule table needs the files")
            parts.append(match_rule_table(self.files, options.rule_table))
        if options.syntax:
            if self.files is None:
                raise ValueError("syntax rules need the files")
            parts.append(scan_syntax(self.files, prune_rules(AI_RULES, options.min_severity)))
        built_in = union_scanners(parts)
        if self.reports is None:
            return built_in
        # A reported finding comes first, so it stands and its built-in double
        # goes. Built-in hits are unique per file and rule, so only rows that
        # share a rule id with a report can be doubles.
        external = dedup_findings(read_semgrep_report(self.reports, options.semgrep_root))
        keys = ("target_id", "file", "rule_id")
        taken = external.select(*keys, F.coalesce("line", F.lit(0)).alias("_line"))
        if options.rule_table is None and not options.syntax:
            taken = taken.filter(F.col("rule_id").isin(*[r.id for r in options.rules]))
        kept = built_in.withColumn("_line", F.coalesce("line", F.lit(0))).join(
            taken.distinct(), [*keys, "_line"], "left_anti")
        return external.unionByName(kept.drop("_line"))

    def findings(self) -> DataFrame:
        """The findings of all scanners chosen, at or above the severity."""
        options, parts = self.options, []
        if self.has_files:
            if options.secrets:
                parts.append(self.secret_findings())
            if options.deps:
                parts.append(self.dependency_findings())
            if options.sast:
                parts.append(self.code_findings())
        if self.responses is not None and options.web:
            parts.append(self._keep("web", lambda: scan_web(self.responses)))
        if not parts:
            return self.spark.createDataFrame([], FINDINGS)
        return filter_severity(union_scanners(parts), options.min_severity)

    def errors(self) -> DataFrame:
        """``(target_id, scanner, error)`` of what could not be scanned: broken
        archives, files over the size limit, entries of manifests, sites."""
        parts = [self.spark.createDataFrame([], _ERRORS)]
        if self.has_files:
            parts.append(self._of_kind("broken").select("target_id", F.lit("archive").alias("scanner"), F.col("content").alias("error")).distinct())
            if self.options.sast:
                parts.append(self._of_kind("skipped").select("target_id", F.lit("sast").alias("scanner"), F.concat("path", F.lit(": "), "content").alias("error")))
            if self.options.deps:
                parts.append(manifest_errors(self.root_files))
        if self.responses is not None and self.options.web:
            parts.append(web_errors(self.responses))
        errors = parts[0]
        for part in parts[1:]:
            errors = errors.unionByName(part)
        return errors

    def summary(self, findings: DataFrame | None = None, durations: DataFrame | None = None) -> DataFrame:
        """One row per target: score, grades, counts, counted files, duration,
        scan type. ``durations`` is ``(target_id, duration)`` as the caller
        measured it. Broken archives and web targets that were not reached are
        left out; they are in ``errors``."""
        findings = self.findings() if findings is None else findings
        targets = self.targets
        if self.responses is not None:
            targets = targets.join(web_errors(self.responses).select("target_id"), "target_id", "left_anti")
        rows = targets.join(score_targets(findings, targets), "target_id")
        if self.has_files:
            counts = self._of_kind("file").groupBy("target_id").agg(F.sum("line").alias("scanned_files"))
            rows = rows.join(counts, "target_id", "left")
        else:
            rows = rows.withColumn("scanned_files", F.lit(None).cast("bigint"))
        if durations is not None:
            rows = rows.join(durations, "target_id", "left")
        else:
            rows = rows.withColumn("duration", F.lit(None).cast("double"))
        files = F.when(F.col("scan_type") == "web", F.lit(0)).otherwise(F.coalesce("scanned_files", F.lit(0)))
        return rows.select(
            "target_id", "scan_type", "score", "grade", "report_grade", "critical", "high", "medium", "low", "total",
            files.cast("bigint").alias("scanned_files"), F.coalesce("duration", F.lit(0.0)).alias("duration"))
