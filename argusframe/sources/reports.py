"""JSON reports of other scanners -> findings.

``reports`` holds ``(target_id, source, json)``. Every mapping is row-local:
parse, explode, project. ``parse_reports`` parses each report once, by the schema of its source; the readers take such a table as well
as one that is not parsed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from argusframe.functions.severity import npm_severity, semgrep_severity, trivy_severity
from argusframe.functions.text import first_present, message, relative_path
from argusframe.schema import SCANNER_ORD, as_findings

SEMGREP = """results array<struct<check_id:string,path:string,start:struct<line:int>,
             extra:struct<severity:string,message:string,fix:string>>>"""
TRIVY = """Results array<struct<Target:string,Vulnerabilities:array<struct<VulnerabilityID:string,PkgName:string,
           InstalledVersion:string,FixedVersion:string,Severity:string,Title:string,Description:string>>>>"""
NPM = "vulnerabilities map<string,variant>"


SCHEMAS = {"semgrep": SEMGREP, "trivy": TRIVY, "npm-audit": NPM}
PARSED = {"semgrep": "semgrep_doc", "trivy": "trivy_doc", "npm-audit": "npm_doc"}


def parse_reports(reports: DataFrame) -> DataFrame:
    """``(target_id, source, semgrep_doc, trivy_doc, npm_doc, readable)``: each report as its source's document, the others null.

    ``readable`` is true for any JSON, also where its fields have other types; only a report that gave no document is
    parsed a second time to see that. The generator keeps later filters from parsing again."""
    docs = [F.when(F.col("source") == source, F.from_json("json", SCHEMAS[source])).alias(name) for source, name in PARSED.items()]
    parsed = reports.select("target_id", "source", "json", F.explode(F.array(F.struct(*docs))).alias("doc"))
    typed = F.lit(False)
    for source, (name, field) in {"semgrep": ("semgrep_doc", "results"), "trivy": ("trivy_doc", "Results"), "npm-audit": ("npm_doc", "vulnerabilities")}.items():
        typed = typed | ((F.col("source") == source) & F.coalesce(F.col("doc")[name][field].isNotNull(), F.lit(False)))
    readable = F.when(typed, True).otherwise(F.try_parse_json("json").isNotNull())
    return parsed.select("target_id", "source", "doc.*", readable.alias("readable"))


def _of_source(reports: DataFrame, source: str) -> DataFrame:
    """``(target_id, doc)`` of the reports of a source."""
    mine = reports.filter(F.col("source") == source)
    return mine.select("target_id", (F.col(PARSED[source]) if PARSED[source] in reports.columns else F.from_json("json", SCHEMAS[source])).alias("doc"))


def read_semgrep_report(reports: DataFrame, root: str = "") -> DataFrame:
    rows = _of_source(reports, "semgrep").select(
        "target_id", F.posexplode("doc.results").alias("seq", "r"))
    check = F.col("r.check_id")
    path = relative_path(F.col("r.path"), root) if root else F.col("r.path")
    return as_findings(rows.select(
        "target_id", F.lit("semgrep").alias("scanner"),
        semgrep_severity(F.col("r.extra.severity")).alias("severity"), F.lit("code").alias("category"),
        first_present(F.substring_index(check, ".", -1), "Code issue").alias("title"),
        first_present(F.col("r.extra.message"), message("Security issue in {path}", path=F.col("r.path"))).alias("description"),
        path.alias("file"), F.when(F.col("r.start.line") != 0, F.col("r.start.line")).alias("line"),
        first_present(F.col("r.extra.fix"), "Look at the code and correct it.").alias("recommendation"),
        check.alias("rule_id"), F.lit(SCANNER_ORD["semgrep"]).alias("scanner_ord"),
        F.lit(0).alias("rule_ord"), "seq"))


def read_trivy_report(reports: DataFrame) -> DataFrame:
    results = _of_source(reports, "trivy").select(
        "target_id", F.posexplode("doc.Results").alias("rpos", "r"))
    rows = results.select(
        "target_id", "rpos", F.col("r.Target").alias("t"), F.posexplode("r.Vulnerabilities").alias("vpos", "v"))
    package, fixed = F.col("v.PkgName"), F.col("v.FixedVersion")
    return as_findings(rows.select(
        "target_id", F.lit("trivy").alias("scanner"),
        trivy_severity(F.col("v.Severity")).alias("severity"), F.lit("dependency").alias("category"),
        message("{id}: {package} {version}", id=F.col("v.VulnerabilityID"), package=package,
                version=F.col("v.InstalledVersion")).alias("title"),
        first_present(F.col("v.Title"), first_present(
            F.col("v.Description"), message("Known flaw in {package}", package=package))).alias("description"),
        first_present(F.col("t"), "unknown").alias("file"),
        F.when(fixed != "", message("Update {package} to {version} or later.", package=package, version=fixed))
        .otherwise(message("No fix is known; look for a replacement of {package}.", package=package)).alias("recommendation"),
        F.col("v.VulnerabilityID").alias("cve"), F.col("v.InstalledVersion").alias("installed_version"),
        fixed.alias("fixed_version"), F.lit(SCANNER_ORD["trivy"]).alias("scanner_ord"),
        F.col("rpos").alias("rule_ord"), F.col("vpos").alias("seq")))


def read_npm_audit_report(reports: DataFrame) -> DataFrame:
    rows = _of_source(reports, "npm-audit").select(
        "target_id", F.posexplode("doc.vulnerabilities").alias("seq", "package", "advisory"))
    rows = rows.select(
        "target_id", "seq", "package",
        F.try_variant_get("advisory", "$.severity", "string").alias("level"),
        F.try_variant_get("advisory", "$.via[0].title", "string").alias("cause"),
        F.try_variant_get("advisory", "$.fixAvailable", "variant").alias("fix"))
    # A fix is either a flag or an object that describes the update.
    fixable = F.coalesce(F.try_variant_get("fix", "$", "boolean"), F.startswith(F.schema_of_variant("fix"), F.lit("OBJECT")), F.lit(False))
    package = F.col("package")
    return as_findings(rows.select(
        "target_id", F.lit("npm-audit").alias("scanner"),
        npm_severity(F.col("level")).alias("severity"), F.lit("dependency").alias("category"),
        message("Vulnerable package: {package}", package=package).alias("title"),
        F.concat(message("{package} has a known flaw of {level} severity.", package=package, level=F.col("level")),
                 F.when(F.col("cause") != "", F.concat(F.lit(" "), F.col("cause"))).otherwise("")).alias("description"),
        F.lit("package.json").alias("file"),
        F.when(fixable, message("Let npm fix it or update {package}.", package=package))
        .otherwise(message("No automatic fix; see whether {package} is needed.", package=package)).alias("recommendation"),
        F.lit(SCANNER_ORD["npm-audit"]).alias("scanner_ord"), F.lit(0).alias("rule_ord"), "seq"))
