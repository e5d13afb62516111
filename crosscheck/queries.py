"""One Spark query per operator, over the derived inputs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from argusframe.functions import severity as sev, text, urls
from argusframe.operators import deps, files as fl, merge, sast, score, secrets, skew, syntax, web
from argusframe.operators.rules import AI_RULES, FILE, LINE, RULES, Rule, number_user_rules, prune_rules
from argusframe.plans import documents as docs
from argusframe.plans.rescan import rescan
from argusframe.plans.scan import Engine, ScanOptions
from argusframe.session import ensure_checkpoint_dir, shuffles_dropped
from argusframe.schema import FILES, FINDINGS, as_findings
from argusframe.sources import archives, reports as rep, results, trees
from argusframe.sources.report_files import write_report_files
from argusframe.sources.rule_catalog import rules_table
from argusframe.streaming import scan_stream as st, score_state as live
from crosscheck.inputs import Inputs, store_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

REPORT_DATE = "2026-01-01"
RULE_COLUMNS = ["target_id", "file", "line", "rule_id"]
WEB_COLUMNS = ["target_id", "rule_id", "severity", "category"]
USER_RULES = number_user_rules([
    Rule("user-total", "low", (".js", ".py"), LINE, r"total\s*=", title="t", description="d", recommendation="r"),
    Rule("user-start", "low", (".js", ".py"), LINE, r"^(?:const|import|def)\b", title="t", description="d", recommendation="r"),
    Rule("user-end", "low", (".js", ".ts"), LINE, r"\)$", title="t", description="d", recommendation="r"),
    Rule("user-gap", "low", (".js", ".ts", ".py"), LINE, r"\)\W+\w", title="t", description="d", recommendation="r"),
    Rule("user-app", "medium", (".ts",), FILE, r"app\.", anti=r"helmet", title="t", description="d", recommendation="r"),
])


def query(name: str):
    def register(f: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
        return f
    return register


def _files(i: Inputs) -> DataFrame:
    return i.derive("files")


def _shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder below the checkpoint folder, which every executor sees."""
    return f"{ensure_checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"


def _land(rows: DataFrame, folder: str, batches: int, *by: str) -> int:
    """Write rows as the files that a stream finds, and say how many of them make one of so many batches. There are as many files as a
    shuffle has partitions, so no task holds a fixed share of the input."""
    spark = rows.sparkSession
    each = -(-max(4, int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism) // batches)
    with shuffles_dropped(spark):
        rows.repartition(each * batches, *by).write.option("compression", "zstd").parquet(folder)
    return each


# Sources and sinks

@query("prune_paths")
def _(i): return fl.prune_paths(_files(i)).select("target_id", "path")


@query("size_cap")
def _(i): return fl.size_cap(_files(i)).select("target_id", "path", "size_bytes")


@query("decode_utf8")
def _(i):
    raw = F.concat(F.encode("content", "UTF-8"), F.lit(b"\xff\xfe"))
    return _files(i).select("target_id", "path", text.decode_utf8(raw).alias("decoded"))


@query("read_zip_archives")
def _(i):
    return archives.unpack_archives(i.archives("zip"), "zip", max_bytes=urls.ARCHIVE_MAX_BYTES).select("target_id", "path", "size_bytes", "content")


@query("read_archives_in_ranges")
def _(i):
    """Archives as files, each dealt to several tasks by ranges of its bytes."""
    folder = _shared_folder(i.spark, "zips")
    store_files(i.archives("zip"), folder)
    return trees.read_archives(i.spark, folder, split_bytes=4096).select("target_id", "path", "size_bytes", "content")


@query("read_folders")
def _(i):
    """The members of the archives as files in one folder for each target."""
    folder = _shared_folder(i.spark, "folders")
    members = i.derive("archive_members")
    store_files(members.select(F.concat_ws("/", "target_id", "path").alias("path"), F.encode("content", "UTF-8").alias("content")), folder)
    return trees.read_folders(i.spark, folder).select("target_id", "path", "size_bytes", "content")


@query("archive_errors")
def _(i):
    """Every archive whose name ends in 3 is cut in half."""
    half = F.expr("substring(content, 1, CAST(octet_length(content) / 2 AS INT))")
    cut = i.archives("zip").withColumn("content", F.when(F.col("path").rlike("3[.]zip$"), half).otherwise(F.col("content")))
    engine = Engine(files=archives.unpack_archives(cut, "zip"), options=ScanOptions(deps=False))
    scored = engine.summary().select("target_id", F.lit("scored").alias("scanner"), F.lit(None).cast("string").alias("error"))
    return engine.errors().filter("scanner = 'archive'").unionByName(scored)


@query("skipped_files")
def _(i): return Engine(files=_files(i), options=ScanOptions(deps=False)).errors()


@query("read_tar_archives")
def _(i): return archives.unpack_archives(i.archives("tar"), "tar", strip=1).select("target_id", "path", "size_bytes", "content")


@query("read_package_manifests")
def _(i):
    return deps.read_package_manifests(i.derive("manifests")).select(
        "target_id", F.size("dependencies").alias("n_main"), F.size("dev_dependencies").alias("n_dev"))


@query("read_requirements")
def _(i): return deps.read_requirements(i.derive("manifests"))


@query("read_semgrep_report")
def _(i): return rep.read_semgrep_report(i.derive("reports")).select("target_id", "seq", "severity", "file", "line", "rule_id")


@query("read_trivy_report")
def _(i): return rep.read_trivy_report(i.derive("reports")).select("target_id", "seq", "severity", "file", "cve", "installed_version", "fixed_version")


@query("read_npm_audit_report")
def _(i): return rep.read_npm_audit_report(i.derive("reports")).select("target_id", "seq", "severity", "file", "title")


@query("read_responses")
def _(i):
    return i.responses.select("target_id", "kind", "path", "status", F.coalesce(F.size("headers"), F.lit(0)).alias("n_headers"),
                              web.header("server").alias("server"), web.header("set-cookie").alias("cookies"))


@query("load_rule_catalog")
def _(i):
    catalog = rules_table(i.spark, RULES).filter(F.col("extension").isNotNull())
    exts = fl.prune_paths(_files(i)).select(text.path_extension(F.col("path")).alias("extension")).groupBy("extension").agg(F.count(F.lit(1)).alias("n"))
    return catalog.join(exts, "extension").groupBy("rule_id", "severity").agg(F.sum("n").alias("files"))


@query("read_scan_results")
def _(i):
    return results.read_scan_results(i.derive("stored_results")).select(
        "target_id", "score", "grade", F.size("findings").alias("n_findings"), "scanned_files", "duration", "scan_type")


@query("count_files")
def _(i):
    f = _files(i)
    return fl.count_files(f, f.select("target_id").distinct())


def _scored(i: Inputs) -> tuple[DataFrame, DataFrame]:
    """Findings of the derived findings table and a summary for them."""
    found = merge.filter_severity(i.derive("findings"))
    summary = score.score_targets(found, i.derive("finding_targets")).select(
        "*", F.lit("code").alias("scan_type"), F.col("total").alias("scanned_files"), F.lit(0.5).alias("duration"))
    return found, summary


@query("write_json_results")
def _(i):
    folder = _shared_folder(i.spark, "results")
    docs.write_json_results(*_scored(i), folder, part_rows=2000)
    text = lambda f: F.concat_ws("|", f["severity"], f["title"], F.coalesce(f["file"], F.lit("")), F.coalesce(f["line"].cast("string"), F.lit("")), F.coalesce(f["ruleId"], F.lit("")))
    return results.read_json_results(i.spark, folder).select(
        "target_id", "part", "score", "grade", "scanned_files", "duration", "scan_type", F.size("findings").alias("n_findings"),
        F.md5(F.array_join(F.transform("findings", text), "\n").cast("binary")).alias("digest"))


@query("json_documents")
def _(i):
    parts = docs.json_documents(*_scored(i), part_rows=2000)
    return parts.select("target_id", "part", "parts", F.size(F.split("text", '"scanner":')).alias("pieces"))


@query("markdown_report")
def _(i): return docs.markdown_documents(*_scored(i), REPORT_DATE, part_rows=2000)


@query("report_files")
def _(i):
    """The documents as one named file for each target, read back from the files."""
    folder = _shared_folder(i.spark, "reports")
    write_report_files(docs.markdown_documents(*_scored(i), REPORT_DATE, part_rows=2000), folder)
    read = trees.read_folders(i.spark, folder, member_bytes=(1 << 31) - 1).filter(F.col("path").endswith(".md"))
    return read.select(F.col("target_id").alias("folder"), F.sha2("content", 256).alias("sha256"))


@query("html_report")
def _(i): return docs.html_documents(*_scored(i), REPORT_DATE, part_rows=2000)


@query("report_path")
def _(i):
    fmt = F.element_at(F.array(*map(F.lit, ("markdown", "html", "json", "other"))), (F.col("request_id") % 4 + 1).cast("int"))
    return i.derive("requests").select("request_id", docs.report_path(fmt, F.col("target")).alias("file"))


# Projections, filters, predicates

@query("classify_target")
def _(i): return i.derive("site_targets").select("target_id", urls.classify_target(F.col("target")).alias("scan_type"))


@query("normalize_url")
def _(i): return i.derive("site_targets").select("target_id", urls.normalize_url(F.col("target")).alias("url"))


@query("http_counterpart")
def _(i): return i.derive("exchanges").select("target_id", "kind", "path", urls.http_counterpart(F.col("url")).alias("url"))


@query("admit_url")
def _(i):
    a = urls.admit_url(F.col("target"))
    return i.derive("site_targets").select("target_id", a["admitted"].alias("admitted"), a["reason"].alias("reason"))


@query("canonical_repo")
def _(i):
    r = urls.canonical_repo(F.col("target"))
    return i.derive("repo_targets").select("page_id", r["owner"].alias("owner"), r["repo"].alias("repo"), r["reason"].alias("reason"))


@query("path_extension")
def _(i): return _files(i).select("target_id", "path", text.path_extension(F.col("path")).alias("ext"))


@query("relative_path")
def _(i): return _files(i).select("target_id", "path", text.relative_path(F.concat(F.lit("/work/"), "path"), F.concat(F.lit("/work/"), F.split("path", "/")[0])).alias("below"))


@query("filter_severity")
def _(i): return merge.filter_severity(i.derive("findings"), "high").select("target_id", "severity", "title", "seq")


@query("select_scanners")
def _(i):
    engine = Engine(files=_files(i), options=ScanOptions(secrets=False, sast=False))
    return engine.findings().select("target_id", "scanner", "file", "line", "rule_id")


@query("admit_archive")
def _(i):
    a = urls.admit_archive(F.col("target"), F.col("size"))
    return i.derive("requests").select("request_id", a["admitted"].alias("admitted"), a["reason"].alias("reason"))


@query("message_template")
def _(i): return sast.scan_sources(_files(i)).select("target_id", "file", "rule_id", "title", "description", "recommendation")


@query("escape_html")
def _(i): return i.derive("findings").select("target_id", "seq", text.escape_html(F.concat_ws("|", "title", "description")).alias("html"))


@query("scalar_functions")
def _(i):
    c = F.col("content")
    return _files(i).select("target_id", "path", text.utf16_length(c).alias("units"), F.length(text.trim_space(c)).alias("trimmed"),
                            text.first_present(F.regexp_extract("path", "^(src)/", 1), "other").alias("top"), sast.newline_count(c).alias("newlines"))


# Static analysis

def _lines(i: Inputs) -> DataFrame:
    return fl.explode_lines(fl.size_cap(fl.prune_paths(_files(i))))


@query("explode_lines")
def _(i): return fl.explode_lines(_files(i)).select("target_id", "path", "line", "text")


@query("suppress_lines")
def _(i): return sast.suppress_lines(_lines(i)).select("target_id", "path", "line")


@query("match_line_rules")
def _(i): return sast.match_line_rules(sast.suppress_lines(_lines(i)))


@query("first_match_per_file")
def _(i): return sast.first_match_per_file(sast.line_matches(_files(i)))


@query("first_line")
def _(i):
    hits = sast.scan_sources(_files(i))
    return hits.filter(F.col("line").isNotNull()).groupBy("target_id", "rule_id").agg(F.min("line").alias("line"), F.count(F.lit(1)).alias("files"))


@query("match_file_rules")
def _(i): return sast.match_file_rules(fl.size_cap(fl.prune_paths(_files(i))))


@query("scan_sources")
def _(i): return sast.scan_sources(_files(i)).select(*RULE_COLUMNS, "severity")


@query("env_not_ignored")
def _(i): return sast.env_not_ignored(_files(i)).select("target_id", "file", "severity", "category")


@query("rule_env_not_gitignored")
def _(i): return sast.env_not_ignored(_files(i)).select(*RULE_COLUMNS)


@query("dedup_findings")
def _(i): return merge.dedup_findings(i.derive("findings")).select("target_id", "file", "line", "rule_id", "title", "scanner", "scanner_ord")


@query("min_severity_rule_prune")
def _(i): return sast.scan_sources(_files(i), prune_rules(RULES, "critical")).select(*RULE_COLUMNS)


@query("user_rules")
def _(i): return sast.scan_sources(_files(i), USER_RULES).select(*RULE_COLUMNS)


@query("files_join_rules")
def _(i):
    table = rules_table(i.spark, USER_RULES).select(
        F.col("rule_id").alias("id"), "severity", "extension", "scope", "pattern", "anti", "title",
        F.lit("d").alias("description"), F.lit("r").alias("recommendation"))
    return sast.match_rule_table(_files(i), table).select(*RULE_COLUMNS)


MANY = 2000


@query("user_rules_table")
def _(i):
    """A table of a few thousand rules; one in twenty looks for a word of its own number."""
    rule = [(f"many-{k}", "low", ext, LINE, rf"\bitem{k}\b" if k % 20 else r"^(?:const|import|def)\b", None, "t", "d", "r") for k in range(MANY) for ext in (".js", ".py")]
    table = i.spark.createDataFrame(rule, "id string, severity string, extension string, scope string, pattern string, anti string, title string, description string, recommendation string")
    return sast.match_rule_table(_files(i), table).groupBy("target_id", "file", "line").agg(F.count(F.lit(1)).alias("n"))


@query("syntax_rules")
def _(i):
    """Every document as a comment in front of code that is laid over lines; which code its number decides."""
    code = F.element_at(F.array(*[F.lit(c) for c in (
        "const app =\n express()\n", "const app = express()\napp\n.use(\n helmet())\n", "res\n.redirect( // so\nreq.query.u)\n", "x = 'jwt.sign(a, \"b\")'\ndb.query(\n'a' +\n x)\n")]),
        (F.col("doc_id") % 4 + 1).cast("int"))
    remark = F.concat(F.lit("/* "), F.replace(F.coalesce("text", F.lit("")), F.lit("*/"), F.lit("")), F.lit(" */\n"))
    texts = i.table("documents").select(F.col("source").alias("target_id"), F.concat(F.lit("d"), F.col("doc_id"), F.lit(".js")).alias("path"),
                                        F.lit(0).alias("size_bytes"), F.concat(remark, code).alias("content"))
    return syntax.scan_syntax(texts).select("target_id", "file", "line", "rule_id", "severity")


@query("rescan_summary")
def _(i):
    """Two scans with one store: of all files but those of every third target, then of all."""
    store = _shared_folder(i.spark, "store")
    options = ScanOptions(deps=False, secrets=False)
    rescan(_files(i).filter("NOT endswith(target_id, '3')"), store, options)
    return rescan(_files(i), store, options).engine.summary().select("target_id", "scan_type", "score", "grade", "critical", "high", "medium", "low", "total", "scanned_files")


def _rule_query(rule: Rule) -> Query:
    return lambda spark, sf_dir: sast.scan_sources(_files(Inputs(spark, sf_dir)), [rule]).select(*RULE_COLUMNS)


for _rule in RULES + AI_RULES:
    if _rule.scope in (LINE, FILE):
        QUERIES["rule_" + _rule.id.replace("-", "_").replace("/", "_")] = _rule_query(_rule)


# Dependencies

def _dependencies(i: Inputs) -> DataFrame:
    return deps.merge_dependencies(deps.read_package_manifests(i.derive("manifests")))


@query("merge_dependencies")
def _(i): return _dependencies(i).select("target_id", "package", "version")


@query("unpinned_npm")
def _(i): return deps.unpinned_npm(_dependencies(i)).select("target_id", "title", "severity")


@query("git_dependency")
def _(i): return deps.git_dependency(_dependencies(i)).select("target_id", "title", "severity")


@query("missing_lockfile")
def _(i): return deps.missing_lockfile(i.derive("manifests")).select("target_id", "file", "severity")


@query("manifest_without_lockfile_anti_join")
def _(i):
    m = i.derive("manifests")
    readable = deps.read_package_manifests(m).select("target_id")
    return readable.join(m.filter(F.col("path").isin(*deps.LOCK_FILES)).select("target_id"), "target_id", "left_anti")


@query("malformed_manifest_guard")
def _(i): return deps.manifest_errors(i.derive("manifests"))


@query("unpinned_python")
def _(i): return deps.unpinned_python(deps.read_requirements(i.derive("manifests"))).select("target_id", "line", "title", "severity")


@query("scan_manifests")
def _(i): return deps.scan_manifests(i.derive("manifests")).groupBy("target_id", "rule_id").agg(F.count(F.lit(1)).alias("n"))


@query("source_cascade")
def _(i):
    found = merge.source_cascade(i.derive("manifests"), i.derive("reports"))
    return found.groupBy("target_id", "scanner").agg(F.count(F.lit(1)).alias("n"))


@query("best_sources")
def _(i): return merge.best_sources(i.derive("manifests"), i.derive("reports"))


# Web

def _web(name: str, check, rule_id: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: check(Inputs(spark, sf_dir).responses).filter(F.col("rule_id") == rule_id).select(*WEB_COLUMNS, "title")


for _r in web.HEADER_RULES:
    _web(_r.id.replace("-", "_"), web.check_headers, _r.id)


def _leak(rule_id: str) -> Query:
    return lambda spark, sf_dir: web.check_headers(Inputs(spark, sf_dir).responses).filter(F.col("rule_id") == rule_id).select(*WEB_COLUMNS, "description")


for _r in web.LEAK_RULES:
    QUERIES[_r.id.replace("-", "_")] = _leak(_r.id)

_web("cookie_no_secure", web.check_cookies, "cookie-no-secure")
_web("cookie_no_httponly", web.check_cookies, "cookie-no-httponly")
_web("cookie_no_samesite", web.check_cookies, "cookie-no-samesite")
_web("cors_wildcard_credentials", web.check_cors, "cors-wildcard-credentials")
_web("cors_wildcard", web.check_cors, "cors-wildcard-origin")
_web("no_https_redirect", web.check_https_redirect, "no-https-redirect")
_web("missing_security_txt", web.check_security_txt, "missing-security-txt")


@query("explode_cookies")
def _(i): return web.explode_cookies(i.responses).select("target_id", "seq", "cookie", "name")


@query("is_session_cookie")
def _(i):
    return web.explode_cookies(i.responses).select("target_id", "name", web.is_session_cookie(F.col("name")).alias("is_session"))


@query("mixed_content")
def _(i): return web.check_mixed_content(i.responses).select(*WEB_COLUMNS, "title", "description")


@query("first_n_examples")
def _(i):
    r, found = i.responses.filter(F.col("kind") == "main"), web.mixed_resources(F.col("body"))
    return r.select("target_id", F.size(found).alias("n"), F.array_join(F.slice(found, 1, 3), " ").alias("examples"))


@query("soft404_baseline")
def _(i): return web.soft404_baseline(i.responses)


def _probe_query(probe: web.Probe) -> Query:
    return lambda spark, sf_dir: web.check_probes(Inputs(spark, sf_dir).responses, (probe,)).select(*WEB_COLUMNS, "file")


for _p in web.PROBES:
    QUERIES[_p.id.replace("-", "_")] = _probe_query(_p)


@query("probe_response_baseline_join")
def _(i): return web.check_probes(i.responses).select("target_id", "rule_id", "file")


@query("robots_sensitive_paths")
def _(i): return web.check_robots(i.responses).select(*WEB_COLUMNS, "description")


@query("headers_anti_join_required")
def _(i):
    required = [r.header for r in web.HEADER_RULES]
    rows = i.responses.filter((F.col("kind") == "main") & F.col("status").isNotNull())
    missing = F.array_except(F.array(*map(F.lit, required)), F.map_keys("headers"))
    return rows.select("target_id", F.explode(missing).alias("header"))


@query("web_scan_errors")
def _(i): return web.web_errors(i.responses)


@query("scan_web")
def _(i): return web.scan_web(i.responses).select(*WEB_COLUMNS)


# External reports

@query("semgrep_severity")
def _(i): return _severities(i, "semgrep", F.expr("from_json(json, 'results array<struct<extra:struct<severity:string>>>').results.extra.severity"), sev.semgrep_severity)


@query("trivy_severity")
def _(i): return _severities(i, "trivy", F.flatten(F.expr(
    "transform(from_json(json, 'Results array<struct<Vulnerabilities:array<struct<Severity:string>>>>').Results, r -> coalesce(r.Vulnerabilities.Severity, array()))")), sev.trivy_severity)


@query("npm_severity")
def _(i): return _severities(i, "npm-audit", F.expr("transform(map_values(from_json(json, 'vulnerabilities map<string,struct<severity:string>>').vulnerabilities), v -> v.severity)"), sev.npm_severity)


def _severities(i: Inputs, source: str, values, mapping) -> DataFrame:
    rows = i.derive("reports").filter(F.col("source") == source).select(F.explode(values).alias("raw"))
    return rows.groupBy("raw").agg(F.count(F.lit(1)).alias("n")).select("raw", mapping(F.col("raw")).alias("severity"), "n")


@query("semgrep_to_finding")
def _(i): return rep.read_semgrep_report(i.derive("reports")).select("target_id", "seq", "title", "description", "recommendation")


@query("trivy_to_finding")
def _(i): return rep.read_trivy_report(i.derive("reports")).select("target_id", "seq", "title", "description", "recommendation")


@query("npm_to_finding")
def _(i): return rep.read_npm_audit_report(i.derive("reports")).select("target_id", "seq", "title", "description", "recommendation")


# Aggregations, windows, orders, sets

@query("severity_counts")
def _(i): return score.severity_counts(i.derive("findings"))


@query("penalty")
def _(i): return score.penalty(i.derive("findings")).select("target_id", F.col("penalty").cast("double").alias("penalty"))


@query("diminish")
def _(i):
    sums = i.derive("findings").groupBy("target_id").agg(score._penalty().alias("penalty"), F.count(F.lit(1)).alias("n"))
    return sums.select("target_id", score.diminish(F.col("penalty"), F.col("n")).cast("double").alias("adjusted"))


def _scores(i: Inputs) -> DataFrame:
    return score.score_targets(merge.filter_severity(i.derive("findings")), i.derive("finding_targets"))


@query("score")
def _(i): return _scores(i).select("target_id", "score")


@query("score_high_only")
def _(i):
    found = merge.filter_severity(i.derive("findings"), "high")
    return score.score_targets(found, i.derive("finding_targets")).select("target_id", "score", "total")


@query("grade_json")
def _(i): return _scores(i).select("target_id", "grade")


@query("grade_report")
def _(i): return _scores(i).select("target_id", "report_grade")


@query("score_band")
def _(i): return _scores(i).select("target_id", score.score_band(F.col("score")).alias("band"), score.terminal_band(F.col("score")).alias("terminal"))


@query("targets_left_join_findings")
def _(i): return _scores(i).filter(F.col("total") == 0).select("target_id", "score")


@query("scan_summary")
def _(i):
    f = _files(i)
    engine = Engine(files=f, options=ScanOptions(deps=False, secrets=False))
    return engine.summary().select("target_id", "scan_type", "score", "grade", "critical", "high", "medium", "low", "total", "scanned_files")


@query("full_scan")
def _(i):
    """Every scanner over code and web targets, with reports merged in."""
    engine = Engine(files=_files(i).unionByName(i.derive("manifests")), responses=i.responses, reports=i.derive("reports"))
    return engine.summary().select("target_id", "scan_type", "score", "grade", "total", "scanned_files")


@query("result_parts")
def _(i):
    return docs.result_parts(*_scored(i), part_rows=2000).select("target_id", "part", "score", F.size("findings").alias("n_findings"),
                                                               F.get("findings", F.lit(0))["title"].alias("first_title"))


@query("preview_findings")
def _(i):
    order = list(merge.EMISSION_ORDER)
    return score.preview_findings(i.derive("findings")).select("target_id", "place", "remaining", *order)


@query("order_by_severity")
def _(i):
    found = merge.filter_severity(i.derive("findings")).withColumn("rank", sev.severity_rank(F.col("severity")))
    return skew.number_rows(found, "target_id", ("rank", *merge.EMISSION_ORDER)).select("target_id", "n", "rank", *merge.EMISSION_ORDER)


@query("emission_order")
def _(i): return skew.number_rows(i.derive("findings"), "target_id", merge.EMISSION_ORDER).select("target_id", "n", *merge.EMISSION_ORDER)


@query("union_scanners")
def _(i):
    f = _files(i)
    parts = [sast.env_not_ignored(f), sast.scan_sources(f), deps.scan_manifests(f), secrets.scan_secrets(f), web.check_cors(i.responses)]
    return merge.union_scanners(parts).groupBy("target_id", "scanner", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("distinct_findings")
def _(i): return merge.dedup_findings(i.derive("findings")).groupBy("target_id").agg(F.count(F.lit(1)).alias("n"))


@query("findings_rollup")
def _(i): return score.findings_rollup(i.derive("findings"))


# Secrets

def _secret(rule_id: str) -> Query:
    rules = tuple(r for r in secrets.SECRET_RULES if r.id == rule_id)
    return lambda spark, sf_dir: secrets.scan_secrets(_files(Inputs(spark, sf_dir)), rules).select("target_id", "file", "line", "seq", "severity", "category")


for _name, _id in (("secret_api_keys", "secret-api-key"), ("secret_generic_token", "secret-generic-token"),
                   ("secret_db_url", "secret-db-url"), ("secret_private_key", "secret-private-key")):
    QUERIES[_name] = _secret(_id)


@query("mask_secret")
def _(i): return secrets.scan_secrets(_files(i)).select("target_id", "file", "line", "seq", "rule_id", "description")


@query("document_secrets")
def _(i):
    """Secrets in the documents as they are given."""
    texts = i.table("documents").select(
        F.col("source").alias("target_id"), F.concat(F.lit("d"), F.col("doc_id")).alias("path"), F.lit(0).alias("size_bytes"), F.col("text").alias("content"))
    return secrets.scan_secrets(texts).select("target_id", "file", "line", "seq", "rule_id")


# Streaming

@query("stream_scan")
def _(i):
    source, out, state = (_shared_folder(i.spark, x) for x in ("files", "findings", "state"))
    _land(_files(i), source, 1)
    found = st.stream_scan(st.stream_files(i.spark, source))
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return i.spark.read.parquet(out).select(*RULE_COLUMNS)


@query("stream_scores")
def _(i):
    """Archives land in a folder; scores per archive as batches arrive."""
    source, out, state = (_shared_folder(i.spark, x) for x in ("archives", "scores", "state"))
    members = i.derive("archive_members").withColumn("size_bytes", F.col("size_bytes").cast("bigint"))
    each = _land(members, source, 2, "path")
    files = i.spark.readStream.schema(FILES).option("maxFilesPerTrigger", each).parquet(source)  # targets are spread over the batches
    live.start_live_scores(files, out, state, ScanOptions(deps=False)).awaitTermination()
    return live.read_live_scores(i.spark, out).select("target_id", "score", "total", "scanned_files")


@query("stream_scores_history")
def _(i):
    """The same from the evidence of all batches, scored when it is read."""
    source, out, state = (_shared_folder(i.spark, x) for x in ("archives", "scores", "state"))
    members = i.derive("archive_members").withColumn("size_bytes", F.col("size_bytes").cast("bigint"))
    each = _land(members, source, 2, "path")
    files = i.spark.readStream.schema(FILES).option("maxFilesPerTrigger", each).parquet(source)
    st.start_scores(files, out, state, ScanOptions(deps=False)).awaitTermination()
    return st.read_scores(i.spark, out, ScanOptions(deps=False)).select("target_id", "score", "total", "scanned_files")


@query("stream_dedup_findings")
def _(i):
    """Findings arrive in batches, doubles and better-ranked ones late; what stands at the end is what one pass keeps."""
    source, out, state = (_shared_folder(i.spark, x) for x in ("findings", "changes", "state"))
    findings = as_findings(i.derive("findings"))
    each = _land(findings, source, 3, "description", "seq")
    stream = i.spark.readStream.schema(FINDINGS).option("maxFilesPerTrigger", each).parquet(source)
    live.start_dedup(stream, out, state).awaitTermination()
    return live.standing_findings(i.spark.read.schema(live.CHANGES).parquet(out)).select("target_id", "file", "line", "rule_id", "title", "scanner", "scanner_ord")


@query("stream_admission")
def _(i):
    source, out, state = (_shared_folder(i.spark, x) for x in ("requests", "admitted", "state"))
    rows = i.derive("requests")
    _land(rows, source, 1)
    stream = i.spark.readStream.schema(rows.schema).parquet(source)
    st.start_admission(stream, out, state).awaitTermination()
    return i.spark.read.schema("request_id bigint, kind string, admitted boolean, reason string").parquet(out)
