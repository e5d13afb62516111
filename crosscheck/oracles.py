"""Plain SQL for each query, written from what the operators mean: line by
line, join by join, not from the Spark expressions. Only data (patterns, word
lists, snippets, report texts) is shared."""

from __future__ import annotations

import re

from argusframe.functions import severity as sev, urls
from argusframe.functions.regex import SPACE as JAVA_SPACE
from argusframe.operators import files as fl, web
from argusframe.operators.rules import AI_RULES, FILE, LINE, RULES, RULES_BY_ID, Rule
from argusframe.operators.sast import scanned_extensions
from argusframe.operators.secrets import SECRET_RULES
from argusframe.plans.documents import MARKDOWN_TAIL
from crosscheck.inputs import BUILDERS, DUCK, docs as docs_sql, quote
from crosscheck.queries import MANY, QUERIES, REPORT_DATE, USER_RULES

ORACLES: dict[str, str] = {}

# RE2 spellings of the ECMAScript classes.
SPACE = re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", JAVA_SPACE)
_DOT = r"[^\n\r\x{2028}\x{2029}]"


def re2(pattern: str, ignore_case: bool = False) -> str:
    out, i = "", 0
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two == r"\s":
            out, i = out + f"[{SPACE}]", i + 2
        elif two[0] == "\\":
            out, i = out + two, i + 2
        elif two[0] == "[":
            end = i + 1
            while pattern[end] != "]":
                end += 2 if pattern[end] == "\\" else 1
            out, i = out + pattern[i:end + 1].replace(r"\s", SPACE), end + 1
        else:
            out, i = out + (_DOT if two[0] == "." else two[0]), i + 1
    return ("(?i)" if ignore_case else "") + out


def matches(subject: str, pattern: str, ignore_case: bool = False) -> str:
    return f"regexp_matches({subject}, {quote(re2(pattern, ignore_case))})"


def with_(body: str, *inputs: str, **ctes: str) -> str:
    parts = [f"{n} AS ({BUILDERS[n](DUCK)})" for n in inputs] + [f"{n} AS MATERIALIZED ({q})" for n, q in ctes.items()]
    return f"WITH {', '.join(parts)} {body}"


def in_list(words) -> str:
    return "(" + ", ".join(quote(w) for w in words) + ")"


def trim_js(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


NAMES = "string_split(path, '/')"
BASE = "list_last(string_split(path, '/'))"
EXT = f"lower(coalesce(nullif(regexp_extract({BASE}, '^.+([.][^.]*)$', 1), ''), ''))"


def walked(kept: str, ignored, depth: int | None = 10) -> str:
    return f"({f'len({NAMES}) <= {depth} AND ' if depth else ''}len(list_filter({NAMES}, lambda x: (starts_with(x, '.') AND NOT ({kept})) OR x IN {in_list(ignored)})) = 0)"


SCANNED = walked("x = '.gitignore'", fl.SCAN_IGNORED)
COUNTED = f"({walked(chr(115) + 'tarts_with(x, ' + quote('.env') + ')', fl.COUNT_IGNORED)} AND ({EXT} IN {in_list(fl.COUNT_EXTENSIONS)} OR starts_with({BASE}, '.env')))"
SECRET_FILES = walked("starts_with(x, '.env')", fl.COUNT_IGNORED, None)

PRUNED = f"SELECT target_id, path, content, {EXT} AS ext FROM files WHERE {SCANNED} AND size_bytes <= 1048576"
LINES = """SELECT target_id, path, ext, unnest(string_split(content, chr(10))) AS text,
    cast(unnest(range(1, len(string_split(content, chr(10))) + 1)) AS INTEGER) AS line FROM pruned"""
_TRIMMED = trim_js("text")
KEPT = f"""SELECT * FROM lines WHERE NOT (starts_with({_TRIMMED}, '//') OR starts_with({_TRIMMED}, '*') OR starts_with({_TRIMMED}, '/*')
    OR regexp_matches(text, '^[{SPACE}]*(pattern|regex|antiPattern|title|description|recommendation|id)[{SPACE}]*:'))"""


def line_test(rule: Rule) -> str:
    if rule.id == "xss-innerhtml":
        # No look-ahead in RE2: a blank after the sign always matches, else
        # some assignment must not be followed by a quoted bare tag.
        start, tag = r"\.innerHTML\s*=", r"""\.innerHTML\s*=['"]<(?:br|hr|p|div)\s*/?>['"]"""
        count = lambda p: f"len(regexp_extract_all(text, {quote(re2(p))}))"
        return f"({matches('text', start + chr(92) + 's')} OR {count(start)} > {count(tag)})"
    return matches("text", rule.pattern, rule.ignore_case)


def line_hits(rule: Rule) -> str:
    return f"SELECT target_id, path, {quote(rule.id)} AS rule_id, line FROM kept WHERE ext IN {in_list(rule.extensions)} AND {line_test(rule)}"


def file_hits(rule: Rule) -> str:
    anti = f" AND NOT {matches('content', rule.anti, rule.anti_ignore_case)}" if rule.anti else ""
    return (f"SELECT target_id, path, {quote(rule.id)} AS rule_id, cast(NULL AS INTEGER) AS line FROM pruned"
            f" WHERE ext IN {in_list(rule.extensions)} AND {matches('content', rule.pattern, rule.ignore_case)}{anti}")


def scan_ctes(rules) -> dict[str, str]:
    """All built-in hits of the rules, first line per file and rule."""
    lines = [line_hits(r) for r in rules if r.scope == LINE]
    whole = [file_hits(r) for r in rules if r.scope == FILE]
    ctes = {"pruned": PRUNED, "lines": LINES, "kept": KEPT}
    firsts = [f"SELECT target_id, path, rule_id, min(line) AS line FROM ({' UNION ALL '.join(lines)}) GROUP BY ALL"] if lines else []
    ctes["hits"] = " UNION ALL ".join(firsts + whole)
    return ctes


def values(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else quote(v) for v in row) + ")" for row in rows)


RULE_META = "SELECT * FROM (VALUES " + values(
    (r.id, r.ord, r.severity, r.title, r.description, r.recommendation) for r in RULES + AI_RULES + USER_RULES
) + ") m(rule_id, rule_ord, severity, title, description, recommendation)"
ENV = """SELECT target_id, CASE WHEN covers IS NULL THEN '.env' ELSE '.gitignore' END AS file FROM (
    SELECT e.target_id, bool_or(contains(g.content, '.env')) AS covers FROM (SELECT DISTINCT target_id FROM files WHERE path = '.env') e
    LEFT JOIN files g ON g.target_id = e.target_id AND g.path = '.gitignore' GROUP BY e.target_id) WHERE covers IS NULL OR NOT covers"""

# Sources and sinks
ORACLES["prune_paths"] = with_(f"SELECT target_id, path FROM files WHERE {SCANNED}", "files")
ORACLES["size_cap"] = with_("SELECT target_id, path, size_bytes FROM files WHERE size_bytes <= 1048576", "files")
ORACLES["decode_utf8"] = with_("SELECT target_id, path, concat(content, chr(65533), chr(65533)) AS decoded FROM files", "files")
_ARCHIVED = """SELECT target_id, path, size_bytes, CASE WHEN starts_with(path, 'node_modules/') THEN NULL ELSE content END AS content FROM archive_members"""
ORACLES["read_zip_archives"] = ORACLES["read_tar_archives"] = ORACLES["read_archives_in_ranges"] = with_(_ARCHIVED, "archive_members")
ORACLES["read_folders"] = with_("SELECT target_id, path, size_bytes, content FROM archive_members WHERE NOT starts_with(path, 'node_modules/') AND NOT starts_with(path, 'lib/.hid/')", "archive_members")
ORACLES["read_package_manifests"] = with_("""SELECT target_id, cast(count(*) FILTER (WHERE NOT is_dev) AS INTEGER) AS n_main,
    cast(count(*) FILTER (WHERE is_dev) AS INTEGER) AS n_dev FROM (SELECT *, concat('order-', ord) AS target_id FROM items WHERE ord % 29 <> 0) GROUP BY target_id""", "items")
REQS = f"""SELECT target_id, cast(line AS INTEGER) AS line, {trim_js("text")} AS requirement FROM (
    SELECT target_id, unnest(string_split(content, chr(10))) AS text, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line
    FROM manifests WHERE path = 'requirements.txt')"""
ORACLES["read_requirements"] = with_(REQS, "manifests")

_BAD = "json_valid(json)"
SEMGREP = f"""SELECT target_id, cast(pos AS INTEGER) AS seq, r->>'$.check_id' AS check_id, r->>'$.path' AS file, cast(r->>'$.start.line' AS INTEGER) AS raw_line,
    r->>'$.extra.severity' AS raw, r->>'$.extra.message' AS msg, r->>'$.extra.fix' AS fix FROM (
    SELECT target_id, unnest(rs) AS r, unnest(range(0, len(rs))) AS pos FROM (
      SELECT target_id, json_extract(json, '$.results[*]') AS rs FROM reports WHERE source = 'semgrep' AND json_valid(json)))"""
SEMGREP_SEV = "CASE upper(raw) WHEN 'ERROR' THEN 'high' WHEN 'WARNING' THEN 'medium' WHEN 'INFO' THEN 'low' ELSE 'medium' END"
TRIVY_RAW = """SELECT target_id, t, cast(pos AS INTEGER) AS seq, v->>'$.VulnerabilityID' AS cve, v->>'$.PkgName' AS pkg, v->>'$.InstalledVersion' AS installed_version,
    v->>'$.FixedVersion' AS fixed_version, v->>'$.Severity' AS raw, v->>'$.Title' AS title, v->>'$.Description' AS descr FROM (
    SELECT target_id, r->>'$.Target' AS t, unnest(vs) AS v, unnest(range(0, len(vs))) AS pos FROM (
      SELECT target_id, r, json_extract(r, '$.Vulnerabilities[*]') AS vs FROM (
        SELECT target_id, unnest(json_extract(json, '$.Results[*]')) AS r FROM (SELECT * FROM reports WHERE source = 'trivy' AND json_valid(json)))))"""
TRIVY_SEV = "CASE upper(raw) WHEN 'CRITICAL' THEN 'critical' WHEN 'HIGH' THEN 'high' WHEN 'MEDIUM' THEN 'medium' ELSE 'low' END"
NPM_RAW = """SELECT target_id, cast(pos AS INTEGER) AS seq, pkg, json_extract(vs, '$."' || pkg || '"') AS a FROM (
    SELECT target_id, vs, unnest(json_keys(vs)) AS pkg, unnest(range(0, len(json_keys(vs)))) AS pos FROM (
      SELECT target_id, json_extract(json, '$.vulnerabilities') AS vs FROM (SELECT * FROM reports WHERE source = 'npm-audit' AND json_valid(json))))"""
NPM = f"""SELECT target_id, seq, pkg, a->>'$.severity' AS raw, CASE WHEN json_type(a, '$.via[0]') = 'OBJECT' THEN a->>'$.via[0].title' END AS cause,
    json_type(a, '$.fixAvailable') = 'OBJECT' OR a->>'$.fixAvailable' = 'true' AS fixable FROM ({NPM_RAW})"""
NPM_SEV = "CASE raw WHEN 'critical' THEN 'critical' WHEN 'high' THEN 'high' WHEN 'moderate' THEN 'medium' ELSE 'low' END"
ORACLES["read_semgrep_report"] = with_(f"SELECT target_id, seq, {SEMGREP_SEV} AS severity, file, nullif(raw_line, 0) AS line, check_id AS rule_id FROM s", "reports", s=SEMGREP)
ORACLES["read_trivy_report"] = with_(f"""SELECT target_id, seq, {TRIVY_SEV} AS severity, coalesce(nullif(t, ''), 'unknown') AS file, cve, installed_version, fixed_version
    FROM t""", "reports", t=TRIVY_RAW)
ORACLES["read_npm_audit_report"] = with_(f"""SELECT target_id, seq, {NPM_SEV} AS severity, 'package.json' AS file, concat('Vulnerable package: ', pkg) AS title FROM n""",
                                         "reports", n=NPM)
ORACLES["semgrep_to_finding"] = with_("""SELECT target_id, seq, coalesce(nullif(list_last(string_split(check_id, '.')), ''), 'Code issue') AS title,
    coalesce(nullif(msg, ''), concat('Security issue in ', file)) AS description, coalesce(nullif(fix, ''), 'Look at the code and correct it.') AS recommendation FROM s""",
                                      "reports", s=SEMGREP)
ORACLES["trivy_to_finding"] = with_("""SELECT target_id, seq, concat(cve, ': ', pkg, ' ', installed_version) AS title,
    coalesce(nullif(title, ''), nullif(descr, ''), concat('Known flaw in ', pkg)) AS description,
    CASE WHEN coalesce(fixed_version, '') <> '' THEN concat('Update ', pkg, ' to ', fixed_version, ' or later.')
         ELSE concat('No fix is known; look for a replacement of ', pkg, '.') END AS recommendation FROM t""", "reports", t=TRIVY_RAW)
ORACLES["npm_to_finding"] = with_("""SELECT target_id, seq, concat('Vulnerable package: ', pkg) AS title,
    concat(pkg, ' has a known flaw of ', raw, ' severity.', CASE WHEN coalesce(cause, '') <> '' THEN concat(' ', cause) ELSE '' END) AS description,
    CASE WHEN fixable THEN concat('Let npm fix it or update ', pkg, '.') ELSE concat('No automatic fix; see whether ', pkg, ' is needed.') END AS recommendation FROM n""",
                                  "reports", n=NPM)
for _name, _cte, _sev in (("semgrep_severity", SEMGREP, SEMGREP_SEV), ("trivy_severity", TRIVY_RAW, TRIVY_SEV), ("npm_severity", NPM, NPM_SEV)):
    ORACLES[_name] = with_(f"SELECT raw, {_sev} AS severity, count(*) AS n FROM x GROUP BY raw", "reports", x=_cte)

_HEADER_COLUMNS = ("h_hsts", "h_csp", "h_nosniff", "h_frame", "h_referrer", "h_permissions", "h_server", "h_powered", "h_aspnet", "h_origin",
                   "h_credentials", "h_location")
_PRESENT = " + ".join(f"(CASE WHEN {c} IS NULL THEN 0 ELSE 1 END)" for c in _HEADER_COLUMNS)
ORACLES["read_responses"] = with_(f"""SELECT target_id, kind, path, status, cast({_PRESENT} + (CASE WHEN coalesce(cookie_1, cookie_2) IS NULL THEN 0 ELSE 1 END) AS INTEGER)
    AS n_headers, h_server AS server, nullif(concat_ws(', ', cookie_1, cookie_2), '') AS cookies FROM exchanges""", "exchanges")
_RULE_EXT = values((r.id, r.severity, e) for r in RULES for e in r.extensions)
ORACLES["load_rule_catalog"] = with_(f"""SELECT r.rule_id, r.severity, count(*) AS files FROM (SELECT {EXT} AS ext FROM files WHERE {SCANNED}) f
    JOIN (VALUES {_RULE_EXT}) r(rule_id, severity, ext) ON r.ext = f.ext GROUP BY ALL""", "files")
ORACLES["read_scan_results"] = with_("""SELECT target_id, coalesce(cast(json->>'$.score' AS INTEGER), 0) AS score, coalesce(json->>'$.grade', 'F') AS grade,
    cast(coalesce(json_array_length(json, '$.findings'), 0) AS INTEGER) AS n_findings, coalesce(cast(json->>'$.scannedFiles' AS BIGINT), 0) AS scanned_files,
    coalesce(cast(json->>'$.duration' AS DOUBLE), 0.0) AS duration, coalesce(json->>'$.scanType', 'code') AS scan_type
    FROM (SELECT target_id, CASE WHEN json_valid(json) THEN json END AS json FROM stored_results) WHERE json IS NOT NULL""", "stored_results")
ORACLES["count_files"] = with_(f"SELECT target_id, count(*) FILTER (WHERE {COUNTED}) AS scanned_files FROM files GROUP BY target_id", "files")

# Scores. Decimals: a penalty has one place, the factor two.
COUNTS = ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in sev.SEVERITIES)
WEIGHT = "CASE severity WHEN 'critical' THEN 20 WHEN 'high' THEN 10 WHEN 'medium' THEN 4 ELSE 1 END"
TIMES10 = "CASE category WHEN 'secret' THEN 15 WHEN 'config' THEN 8 WHEN 'dependency' THEN 9 ELSE 10 END"
TENTHS = f"sum(({WEIGHT}) * ({TIMES10}))"
# penalty / 10 * (100 - min(40, n)) / 100, kept in thousandths
ADJUSTED = "cast(coalesce(tenths, 0) AS HUGEINT) * (100 - least(40, coalesce(n, 0)))"
SCORE = f"cast(greatest(0, cast(floor(cast(100500 - {ADJUSTED} AS DOUBLE) / 1000) AS BIGINT)) AS INTEGER)"
GRADE_JSON = "CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END"
GRADE_REPORT = "CASE WHEN score >= 90 THEN 'A+' WHEN score >= 80 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 50 THEN 'D' ELSE 'F' END"
KNOWN = "severity IN ('critical', 'high', 'medium', 'low')"


def scored_ctes(found: str, targets: str) -> dict[str, str]:
    sums = f"SELECT target_id, {COUNTS}, count(*) AS n, {TENTHS} AS tenths FROM ({found}) GROUP BY target_id"
    zero = ", ".join(f"coalesce({s}, 0) AS {s}" for s in sev.SEVERITIES)
    return {
        "sums": sums,
        "raw_scores": f"SELECT t.target_id, {SCORE} AS score, {zero}, coalesce(n, 0) AS total FROM ({targets}) t LEFT JOIN sums s ON s.target_id = t.target_id",
        "scores": f"SELECT *, {GRADE_JSON} AS grade, {GRADE_REPORT} AS report_grade FROM raw_scores",
    }


SCORED = scored_ctes(f"SELECT * FROM findings WHERE {KNOWN}", "SELECT target_id FROM finding_targets")


def scored(body: str, **more: str) -> str:
    return with_(body, "findings", "finding_targets", **SCORED, **more)


ORACLES["severity_counts"] = with_(f"SELECT target_id, {COUNTS} FROM findings GROUP BY target_id", "findings")
ORACLES["penalty"] = with_(f"SELECT target_id, cast({TENTHS} AS DOUBLE) / 10 AS penalty FROM findings GROUP BY target_id", "findings")
ORACLES["diminish"] = with_(f"""SELECT target_id, cast({ADJUSTED} AS DOUBLE) / 1000 AS adjusted
    FROM (SELECT target_id, {TENTHS} AS tenths, count(*) AS n FROM findings GROUP BY target_id)""", "findings")
ORACLES["score"] = scored("SELECT target_id, score FROM scores")
ORACLES["score_high_only"] = with_("SELECT target_id, score, total FROM scores", "findings", "finding_targets",
                                   **scored_ctes("SELECT * FROM findings WHERE severity IN ('critical', 'high')", "SELECT target_id FROM finding_targets"))
ORACLES["grade_json"] = scored("SELECT target_id, grade FROM scores")
ORACLES["grade_report"] = scored("SELECT target_id, report_grade FROM scores")
ORACLES["score_band"] = scored("""SELECT target_id, CASE WHEN score >= 80 THEN '#22c55e' WHEN score >= 60 THEN '#eab308' WHEN score >= 40 THEN '#f97316' ELSE '#ef4444' END AS band,
    CASE WHEN score >= 80 THEN 'green' WHEN score >= 60 THEN 'yellow' ELSE 'red' END AS terminal FROM scores""")
ORACLES["targets_left_join_findings"] = scored("SELECT target_id, 100 AS score FROM finding_targets WHERE target_id NOT IN (SELECT target_id FROM sums)")
EMITTED = "scanner_ord NULLS FIRST, file NULLS FIRST, rule_ord NULLS FIRST, seq NULLS FIRST, line NULLS FIRST, rule_id NULLS FIRST, title NULLS FIRST, description NULLS FIRST, severity NULLS FIRST"
EMITTED_COLUMNS = "scanner_ord, file, rule_ord, seq, line, rule_id, title, description, severity"
RANK = "CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 END"
ORACLES["preview_findings"] = with_(f"""SELECT target_id, cast(place AS INTEGER) AS place, greatest(n - 3, 0) AS remaining, {EMITTED_COLUMNS} FROM (
    SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY {EMITTED}) AS place, count(*) OVER (PARTITION BY target_id) AS n FROM findings) WHERE place <= 3""", "findings")
ORACLES["order_by_severity"] = with_(f"""SELECT target_id, row_number() OVER (PARTITION BY target_id ORDER BY rank, {EMITTED}) AS n, rank, {EMITTED_COLUMNS}
    FROM (SELECT *, cast({RANK} AS INTEGER) AS rank FROM findings WHERE {KNOWN})""", "findings")
ORACLES["emission_order"] = with_(f"SELECT target_id, row_number() OVER (PARTITION BY target_id ORDER BY {EMITTED}) AS n, {EMITTED_COLUMNS} FROM findings", "findings")
FIRSTS = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id, file, line, coalesce(nullif(rule_id, ''), title)
    ORDER BY scanner_ord, rule_ord, seq, title, description) AS rn FROM findings) WHERE rn = 1"""
ORACLES["dedup_findings"] = with_("SELECT target_id, file, line, rule_id, title, scanner, scanner_ord FROM d", "findings", d=FIRSTS)
ORACLES["distinct_findings"] = with_("SELECT target_id, count(*) AS n FROM (SELECT DISTINCT target_id, file, line, coalesce(nullif(rule_id, ''), title) AS k FROM findings) GROUP BY 1", "findings")
ORACLES["findings_rollup"] = with_("SELECT target_id, scanner, severity, count(*) AS findings FROM findings GROUP BY ROLLUP (target_id, scanner, severity)", "findings")
ORACLES["filter_severity"] = with_("SELECT target_id, severity, title, seq FROM findings WHERE severity IN ('critical', 'high')", "findings")
ORACLES["escape_html"] = with_("""SELECT target_id, seq, replace(replace(replace(replace(replace(concat(title, '|', description), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
    '"', '&quot;'), '''', '&#039;') AS html FROM findings""", "findings")

# Documents, 2000 findings a part
_PART = "cast(floor((n - 1) / 2000) AS INTEGER)"
_NPARTS = "cast(greatest(1, ceil(total / 2000.0)) AS INTEGER)"
PART_GRID = f"SELECT s.*, {_NPARTS} AS parts, cast(unnest(range(0, {_NPARTS})) AS INTEGER) AS part FROM scores s"
NUMBERED = f"SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY {EMITTED}) AS n FROM findings WHERE {KNOWN}"
_SIZES = f"SELECT target_id, {_PART} AS part, count(*) AS c, arg_min(title, n) AS first_title FROM numbered GROUP BY 1, 2"
_DIGESTS = f"""SELECT target_id, {_PART} AS part, count(*) AS c, md5(string_agg(concat_ws('|', severity, title, coalesce(file, ''),
    coalesce(cast(line AS VARCHAR), ''), coalesce(rule_id, '')), chr(10) ORDER BY n)) AS digest FROM numbered GROUP BY 1, 2"""
ORACLES["write_json_results"] = scored("""SELECT g.target_id, g.part, g.score, g.grade, g.total AS scanned_files, cast(0.5 AS DOUBLE) AS duration, 'code' AS scan_type,
    cast(coalesce(c, 0) AS INTEGER) AS n_findings, coalesce(digest, md5('')) AS digest FROM grid g
    LEFT JOIN sizes z ON z.target_id = g.target_id AND z.part = g.part""", grid=PART_GRID, numbered=NUMBERED, sizes=_DIGESTS)
ORACLES["result_parts"] = scored("""SELECT g.target_id, g.part, g.score, cast(coalesce(c, 0) AS INTEGER) AS n_findings, first_title FROM grid g
    LEFT JOIN sizes z ON z.target_id = g.target_id AND z.part = g.part""", grid=PART_GRID, numbered=NUMBERED, sizes=_SIZES)
ORACLES["json_documents"] = scored("""SELECT g.target_id, g.part, g.parts, cast(coalesce(c, 0) + 1 AS INTEGER) AS pieces FROM grid g
    LEFT JOIN sizes z ON z.target_id = g.target_id AND z.part = g.part""", grid=PART_GRID, numbered=NUMBERED, sizes=_SIZES)
NL = "chr(10)"
_SEV_NUMBERED = f"""SELECT f.*, row_number() OVER (PARTITION BY target_id ORDER BY {RANK}, {EMITTED}) AS n,
    row_number() OVER (PARTITION BY target_id, severity ORDER BY {EMITTED}) AS in_severity FROM findings f WHERE {KNOWN}"""
_OF_SEV = "CASE f.severity WHEN 'critical' THEN s.critical WHEN 'high' THEN s.high WHEN 'medium' THEN s.medium ELSE s.low END"
_MD_ITEM = f"""concat(CASE WHEN in_severity = 1 THEN concat('## ', f.severity, ': ', {_OF_SEV}, {NL}, {NL}) ELSE '' END, '- **', f.title, '**',
    CASE WHEN f.file IS NULL THEN '' ELSE concat(' in `', f.file, '`', CASE WHEN coalesce(f.line, 0) = 0 THEN '' ELSE concat(', line ', f.line) END) END,
    {NL}, '  ', f.description, {NL}, '  *Fix:* ', f.recommendation, {NL}, {NL})"""
_MD_HEAD = f"""concat('# ', g.target_id, ': ', g.score, ' of 100, grade ', g.report_grade, {NL}, {NL}, 'Scanned on {REPORT_DATE} in 0.5s. ',
    CASE WHEN g.total = 0 THEN 'Nothing was found' ELSE concat(g.total, ' findings',
      {", ".join(f"CASE WHEN g.{s} > 0 THEN concat(', ', g.{s}, ' {s}') ELSE '' END" for s in sev.SEVERITIES)}) END, '.', {NL}, {NL})"""


def _document(item: str, numbered: str, head: str, tail: str) -> str:
    bodies = f"SELECT f.target_id, {_PART} AS part, string_agg({item}, '' ORDER BY n) AS body FROM numbered f JOIN scores s ON s.target_id = f.target_id GROUP BY 1, 2"
    return scored(f"""SELECT g.target_id, g.part, g.parts, concat(CASE WHEN g.part = 0 THEN {head} ELSE '' END, coalesce(body, ''),
        CASE WHEN g.part = g.parts - 1 THEN {tail} ELSE '' END) AS text FROM grid g LEFT JOIN bodies b ON b.target_id = g.target_id AND b.part = g.part""",
                  grid=PART_GRID, numbered=numbered, bodies=bodies)


def esc(x: str) -> str:
    return f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;')"


ORACLES["markdown_report"] = _document(_MD_ITEM, _SEV_NUMBERED, _MD_HEAD, f"replace({quote(MARKDOWN_TAIL.replace(chr(10), '¶'))}, '¶', {NL})")
_HTML_ITEM = f"""concat('<li class="', f.severity, '"><b>', upper(f.severity), '</b> <span>', {esc('f.title')}, '</span><p>', {esc('f.description')}, '</p>',
    CASE WHEN f.file IS NULL THEN '' ELSE concat('<p class="place"><code>', {esc('f.file')}, CASE WHEN coalesce(f.line, 0) = 0 THEN '' ELSE concat(':', f.line) END, '</code></p>') END,
    '<p><strong>Fix:</strong> ', {esc('f.recommendation')}, '</p></li>', {NL})"""
_HTML_HEAD = f"""concat('<!DOCTYPE html>', {NL}, '<html lang="en"><head><meta charset="UTF-8"><title>Security report: ', g.score, '/100</title></head>', {NL}, '<body><h1 style="color:',
    CASE WHEN g.score >= 80 THEN '#22c55e' WHEN g.score >= 60 THEN '#eab308' WHEN g.score >= 40 THEN '#f97316' ELSE '#ef4444' END, '">', g.score, ' out of 100</h1><p>Grade: ', g.report_grade, '</p>',
    '<p>', {esc('g.target_id')}, ', scanned on {REPORT_DATE} in 0.5s</p>', {NL}, '<table><tr>',
    {", ".join(f"concat('<td class=" + chr(34) + s + chr(34) + f">', g.{s}, ' {s}</td>')" for s in sev.SEVERITIES)}, '</tr></table>', {NL},
    CASE WHEN g.total = 0 THEN concat('<p>Nothing was found.</p>', {NL}) ELSE concat('<ul>', {NL}) END)"""
ORACLES["html_report"] = _document(_HTML_ITEM, NUMBERED, _HTML_HEAD, f"concat(CASE WHEN g.total = 0 THEN '' ELSE concat('</ul>', {NL}) END, '</body></html>', {NL})")
ORACLES["report_path"] = with_("""SELECT request_id, CASE WHEN target <> '' THEN target ELSE
    CASE request_id % 4 WHEN 0 THEN 'security-report.md' WHEN 1 THEN 'security-report.html' ELSE 'security-report.json' END END AS file FROM requests""", "requests")

# Targets and addresses
ORACLES["classify_target"] = with_("""SELECT target_id, CASE WHEN regexp_matches(target, '(?i)^https?://') OR regexp_matches(target, '(?i)^[a-z0-9][-a-z0-9]*\\.[a-z]{2,}')
    THEN 'web' ELSE 'code' END AS scan_type FROM site_targets""", "site_targets")
ORACLES["normalize_url"] = with_(f"""SELECT target_id, rtrim(CASE WHEN starts_with(t, 'http://') OR starts_with(t, 'https://') THEN t ELSE concat('https://', t) END, '/') AS url
    FROM (SELECT target_id, {trim_js('target')} AS t FROM site_targets)""", "site_targets")
ORACLES["http_counterpart"] = with_("""SELECT target_id, kind, path, CASE WHEN starts_with(url, 'https://') THEN concat('http://', substr(url, 9)) ELSE url END AS url FROM exchanges""", "exchanges")


def host_ctes(source: str, text: str) -> dict[str, str]:
    """Authority up to the first separator, less user part and port."""
    return {
        "addressed": f"SELECT *, CASE WHEN starts_with(t, 'http') THEN t ELSE concat('https://', t) END AS a FROM (SELECT *, {text} AS t FROM {source})",
        "rested": "SELECT *, ltrim(substr(a, length(regexp_extract(a, '(?i)^https?:')) + 1), '/\\') AS rest, regexp_matches(a, '(?i)^https?:') AS has_scheme FROM addressed",
        "authority": "SELECT *, list_last(string_split(regexp_extract(rest, '^[^/?#\\\\]*'), '@')) AS auth FROM rested",
        "hosted": """SELECT *, CASE WHEN has_scheme AND regexp_matches(auth, '^[^:@\\s<>^|%\\[\\]]+(:[0-9]*)?$')
            AND coalesce(try_cast(nullif(regexp_extract(auth, ':([0-9]*)$', 1), '') AS BIGINT), 0) <= 65535
            THEN lower(string_split(auth, ':')[1]) END AS host, substr(rest, length(regexp_extract(rest, '^[^/?#\\\\]*')) + 1) AS tail FROM authority""",
    }


_REASON = """CASE WHEN host IS NULL THEN 'invalid url' WHEN host IN ('localhost', '127.0.0.1', '0.0.0.0') OR starts_with(host, '192.168.') OR starts_with(host, '10.')
    OR starts_with(host, '172.') OR ends_with(host, '.local') THEN 'private address' END"""
ORACLES["admit_url"] = with_("SELECT target_id, reason IS NULL AS admitted, reason FROM (SELECT target_id, " + _REASON + " AS reason FROM hosted)", "site_targets",
                             **host_ctes("site_targets", trim_js("target")))
_REPO_TEXT = f"rtrim(regexp_replace({trim_js('target')}, '\\.git$', ''), '/')"
_REPO_PARTS = """SELECT *, string_split(ltrim(regexp_extract(tail, '^[^?#]*'), '/'), '/') AS parts FROM hosted"""
_REPO_REASON = """CASE WHEN host IS NULL THEN 'invalid url' WHEN host NOT IN ('github.com', 'www.github.com') THEN 'unsupported host'
    WHEN coalesce(parts[1], '') = '' OR coalesce(parts[2], '') = '' THEN 'owner and repository required' END"""
ORACLES["canonical_repo"] = with_(f"""SELECT page_id, CASE WHEN reason IS NULL THEN regexp_replace(parts[1], '[^a-zA-Z0-9_.-]', '', 'g') END AS owner,
    CASE WHEN reason IS NULL THEN regexp_replace(parts[2], '[^a-zA-Z0-9_.-]', '', 'g') END AS repo, reason FROM (SELECT *, {_REPO_REASON} AS reason FROM cut)""",
                                  "repo_targets", **host_ctes("repo_targets", _REPO_TEXT), cut=_REPO_PARTS)
_ARCHIVE_REASON = "CASE WHEN NOT ends_with(target, '.zip') THEN 'not a zip archive' WHEN size > 52428800 THEN 'archive too large' END"
ORACLES["admit_archive"] = with_(f"SELECT request_id, reason IS NULL AS admitted, reason FROM (SELECT request_id, {_ARCHIVE_REASON} AS reason FROM requests)", "requests")
_ADMISSION = host_ctes("requests", trim_js("target"))
_STREAM_REASON = f"""CASE WHEN target = '' THEN 'nothing to scan' WHEN kind = 'website' THEN {_REASON} WHEN kind = 'repo' THEN r.reason
    WHEN kind = 'archive' THEN {_ARCHIVE_REASON} ELSE 'unknown kind of request' END"""
ORACLES["stream_admission"] = with_(
    f"SELECT request_id, kind, reason IS NULL AS admitted, reason FROM (SELECT h.request_id, kind, {_STREAM_REASON} AS reason FROM hosted h JOIN repo r ON r.request_id = h.request_id)",
    "requests", **_ADMISSION,
    repo=f"SELECT request_id, {_REPO_REASON} AS reason FROM (SELECT *, string_split(ltrim(regexp_extract(tail, '^[^?#]*'), '/'), '/') AS parts FROM hosted)")

# Files
ORACLES["path_extension"] = with_(f"SELECT target_id, path, {EXT} AS ext FROM files", "files")
ORACLES["relative_path"] = with_("""SELECT target_id, path, CASE WHEN contains(path, '/') THEN substr(path, strpos(path, '/') + 1) ELSE concat('/work/', path) END AS below FROM files""", "files")
ORACLES["scalar_functions"] = with_(f"""SELECT target_id, path, cast(length(content) + len(regexp_extract_all(content, '[\\x{{10000}}-\\x{{10FFFF}}]')) AS INTEGER) AS units,
    cast(length({trim_js('content')}) AS INTEGER) AS trimmed, CASE WHEN starts_with(path, 'src/') THEN 'src' ELSE 'other' END AS top,
    cast(len(string_split(content, chr(10))) - 1 AS INTEGER) AS newlines FROM files""", "files")
ORACLES["explode_lines"] = with_("""SELECT target_id, path, cast(unnest(range(1, len(string_split(content, chr(10))) + 1)) AS INTEGER) AS line,
    unnest(string_split(content, chr(10))) AS text FROM files""", "files")

# Static analysis
ORACLES["suppress_lines"] = with_("SELECT target_id, path, line FROM kept", "files", pruned=PRUNED, lines=LINES, kept=KEPT)
_ALL_LINES = " UNION ALL ".join(line_hits(r) for r in RULES if r.scope == LINE)
ORACLES["match_line_rules"] = with_(f"SELECT target_id, path, line, rule_id FROM ({_ALL_LINES})", "files", pruned=PRUNED, lines=LINES, kept=KEPT)
ORACLES["first_match_per_file"] = with_(f"SELECT target_id, path, rule_id, min(line) AS line FROM ({_ALL_LINES}) GROUP BY ALL", "files", pruned=PRUNED, lines=LINES, kept=KEPT)
ORACLES["first_line"] = with_("SELECT target_id, rule_id, min(line) AS line, count(*) AS files FROM hits WHERE line IS NOT NULL GROUP BY ALL", "files", **scan_ctes(RULES))
ORACLES["match_file_rules"] = with_(f"SELECT target_id, path, rule_id FROM ({' UNION ALL '.join(file_hits(r) for r in RULES if r.scope == FILE)})", "files", pruned=PRUNED)
ORACLES["scan_sources"] = with_("SELECT target_id, path AS file, line, h.rule_id, severity FROM hits h JOIN meta m ON m.rule_id = h.rule_id", "files", **scan_ctes(RULES), meta=RULE_META)
ORACLES["message_template"] = with_("""SELECT target_id, path AS file, h.rule_id, title,
    concat(description, CASE WHEN line IS NULL THEN '' ELSE concat(' Found in `', path, '` on line ', line, '.') END) AS description, recommendation
    FROM hits h JOIN meta m ON m.rule_id = h.rule_id""", "files", **scan_ctes(RULES), meta=RULE_META)
ORACLES["env_not_ignored"] = with_("SELECT target_id, file, 'high' AS severity, 'config' AS category FROM env", "files", env=ENV)
ORACLES["rule_env_not_gitignored"] = with_("SELECT target_id, file, cast(NULL AS INTEGER) AS line, 'env-not-gitignored' AS rule_id FROM env", "files", env=ENV)
_HITS = "SELECT target_id, path AS file, line, rule_id FROM hits"
ORACLES["min_severity_rule_prune"] = with_("SELECT target_id, path AS file, line, h.rule_id FROM hits h JOIN meta m ON m.rule_id = h.rule_id WHERE severity = 'critical'",
                                           "files", **scan_ctes(RULES), meta=RULE_META)
ORACLES["user_rules_table"] = with_(f"""SELECT target_id, path AS file, min(line) AS line, cast({MANY // 20} AS BIGINT) AS n FROM kept
    WHERE ext IN ('.js', '.py') AND {matches('text', '^(?:const|import|def)' + chr(92) + 'b')} GROUP BY 1, 2""", "files", **scan_ctes(USER_RULES))
ORACLES["archive_errors"] = with_("""SELECT DISTINCT target_id, CASE WHEN ends_with(target_id, '3') THEN 'archive' ELSE 'scored' END AS scanner,
    CASE WHEN ends_with(target_id, '3') THEN 'archive is broken' END AS error FROM archive_members""", "archive_members")
ORACLES["skipped_files"] = with_(f"""SELECT target_id, 'sast' AS scanner, concat(path, ': over 1048576 bytes, not searched by the code rules') AS error FROM files
    WHERE size_bytes > 1048576 AND {SCANNED} AND {EXT} IN {in_list(scanned_extensions(RULES))}""", "files")
ORACLES["user_rules"] = ORACLES["files_join_rules"] = with_(_HITS, "files", **scan_ctes(USER_RULES))
ORACLES["stream_scan"] = with_(_HITS, "files", **scan_ctes(RULES))
for _rule in RULES + AI_RULES:
    if _rule.scope in (LINE, FILE):
        ORACLES["rule_" + _rule.id.replace("-", "_").replace("/", "_")] = with_(_HITS, "files", **scan_ctes([_rule]))
_CODE_FOUND = """SELECT target_id, 'code' AS category, severity FROM hits h JOIN meta m ON m.rule_id = h.rule_id
    UNION ALL SELECT target_id, 'config' AS category, 'high' AS severity FROM env"""
ORACLES["scan_summary"] = with_(
    f"""SELECT s.target_id, 'code' AS scan_type, score, grade, critical, high, medium, low, total, scanned_files FROM scores s
    JOIN (SELECT target_id, count(*) FILTER (WHERE {COUNTED}) AS scanned_files FROM files GROUP BY target_id) c ON c.target_id = s.target_id""",
    "files", **scan_ctes(RULES), meta=RULE_META, env=ENV, **scored_ctes(_CODE_FOUND, "SELECT DISTINCT target_id FROM files"))
ORACLES["syntax_rules"] = """SELECT source AS target_id, concat('d', doc_id, '.js') AS file, breaks + CASE doc_id % 4 WHEN 3 THEN 3 ELSE 2 END AS line,
    CASE doc_id % 4 WHEN 0 THEN 'ai/express-no-helmet' WHEN 2 THEN 'ai/unvalidated-redirect' ELSE 'ai/raw-sql-concatenation' END AS rule_id,
    CASE doc_id % 4 WHEN 3 THEN 'high' ELSE 'medium' END AS severity
  FROM (SELECT *, cast(length(t) - length(replace(t, chr(10), '')) AS INTEGER) AS breaks FROM (SELECT doc_id, source, coalesce(text, '') AS t FROM documents)) WHERE doc_id % 4 <> 1"""
ORACLES["rescan_summary"] = ORACLES["scan_summary"]
ORACLES["report_files"] = f"SELECT target_id AS folder, sha256(string_agg(text, '' ORDER BY part)) AS sha256 FROM ({ORACLES['markdown_report']}) GROUP BY target_id"

# Secrets


def secret_hits(rule) -> str:
    found = f"regexp_extract_all(text, {quote(rule.pattern)}, {rule.group})"
    return (f"SELECT target_id, path AS file, line, cast(unnest(range(0, len({found}))) AS INTEGER) AS seq, {quote(rule.severity)} AS severity, 'secret' AS category,"
            f" {quote(rule.id)} AS rule_id, unnest({found}) AS secret FROM slines")


SLINES = """SELECT target_id, path, unnest(string_split(content, chr(10))) AS text, cast(unnest(range(1, len(string_split(content, chr(10))) + 1)) AS INTEGER) AS line FROM sfiles"""
SFILES = f"SELECT target_id, path, content FROM files WHERE {SECRET_FILES}"
for _name, _rule in zip(("secret_api_keys", "secret_generic_token", "secret_db_url", "secret_private_key"), SECRET_RULES):
    ORACLES[_name] = with_(f"SELECT target_id, file, line, seq, severity, category FROM ({secret_hits(_rule)})", "files", sfiles=SFILES, slines=SLINES)
ALL_SECRETS = " UNION ALL ".join(secret_hits(r) for r in SECRET_RULES)
ORACLES["mask_secret"] = with_(f"""SELECT target_id, file, line, seq, rule_id, concat('`', left(secret, 4), repeat('*', cast(greatest(length(secret) - 4, 0) AS INTEGER)),
    '` looks like a secret, in `', file, '` on line ', line, '.') AS description FROM ({ALL_SECRETS})""", "files", sfiles=SFILES, slines=SLINES)
ORACLES["document_secrets"] = with_(f"SELECT target_id, file, line, seq, rule_id FROM ({ALL_SECRETS})",
                                    sfiles="SELECT source AS target_id, concat('d', doc_id) AS path, text AS content FROM documents", slines=SLINES)
_ARCHIVE_FILES = "SELECT target_id, path, size_bytes, CASE WHEN starts_with(path, 'node_modules/') THEN NULL ELSE content END AS content FROM archive_members"
ORACLES["stream_scores"] = with_(
    f"""SELECT s.target_id, score, total, scanned_files FROM scores s
    JOIN (SELECT target_id, count(*) FILTER (WHERE {COUNTED}) AS scanned_files FROM files GROUP BY target_id) c ON c.target_id = s.target_id""",
    "archive_members", files="SELECT * FROM archive_members", **scan_ctes(RULES), meta=RULE_META, env=ENV, sfiles=SFILES, slines=SLINES,
    secret_rows=f"SELECT target_id, category, severity FROM ({ALL_SECRETS})",
    **scored_ctes(_CODE_FOUND + " UNION ALL SELECT target_id, category, severity FROM secret_rows", "SELECT DISTINCT target_id FROM files"))
ORACLES["stream_scores_history"] = ORACLES["stream_scores"]
ORACLES["stream_dedup_findings"] = ORACLES["dedup_findings"]

# Dependencies
DEPS = """SELECT concat('order-', ord) AS target_id, package, version, kind FROM (
    SELECT *, row_number() OVER (PARTITION BY ord, package ORDER BY is_dev DESC, num DESC, sup DESC, qty DESC, price DESC) AS rn FROM items WHERE ord % 29 <> 0) WHERE rn = 1"""
NO_LOCK = "SELECT DISTINCT concat('order-', ord) AS target_id FROM items WHERE ord % 29 <> 0 AND ord % 3 <> 0 AND ord % 5 <> 0"
LOOSE_PY = """SELECT target_id, line, package FROM (SELECT target_id, line, trim(regexp_extract(requirement, '^[^<>=!]*')) AS package FROM reqs
    WHERE requirement <> '' AND NOT starts_with(requirement, '#') AND NOT contains(requirement, '==') AND NOT contains(requirement, '>=') AND NOT contains(requirement, '~=')) WHERE package <> ''"""
ORACLES["merge_dependencies"] = with_("SELECT target_id, package, version FROM d", "items", d=DEPS)
ORACLES["unpinned_npm"] = with_("SELECT target_id, concat('Loose dependency: ', package) AS title, 'medium' AS severity FROM d WHERE version IN ('*', 'latest')", "items", d=DEPS)
_IS_GIT = "(starts_with(version, 'git') OR contains(version, 'github.com'))"
ORACLES["git_dependency"] = with_(f"SELECT target_id, concat('Dependency from git: ', package) AS title, 'medium' AS severity FROM d WHERE {_IS_GIT}", "items", d=DEPS)
ORACLES["missing_lockfile"] = with_("SELECT target_id, 'package.json' AS file, 'medium' AS severity FROM n", "items", n=NO_LOCK)
ORACLES["manifest_without_lockfile_anti_join"] = with_("SELECT target_id FROM n", "items", n=NO_LOCK)
ORACLES["malformed_manifest_guard"] = with_("""SELECT DISTINCT concat('order-', ord) AS target_id, 'deps' AS scanner, 'package.json: unreadable' AS error FROM items WHERE ord % 29 = 0
    UNION ALL SELECT target_id, 'deps' AS scanner, concat('package.json: version of ', package, ' is no text') AS error FROM d WHERE kind = 6""", "items", d=DEPS)
ORACLES["unpinned_python"] = with_("SELECT target_id, line, concat('Loose Python dependency: ', package) AS title, 'low' AS severity FROM loose", "manifests", reqs=REQS, loose=LOOSE_PY)
_BUILT_IN = f"""SELECT target_id, 'unpinned-npm' AS rule_id FROM d WHERE version IN ('*', 'latest') UNION ALL SELECT target_id, 'git-dependency' AS rule_id FROM d WHERE {_IS_GIT}
    UNION ALL SELECT target_id, 'missing-lockfile' AS rule_id FROM nolock UNION ALL SELECT target_id, 'unpinned-python' AS rule_id FROM loose"""
ORACLES["scan_manifests"] = with_(f"SELECT target_id, rule_id, count(*) AS n FROM ({_BUILT_IN}) GROUP BY ALL", "items", "manifests", d=DEPS, nolock=NO_LOCK, reqs=REQS, loose=LOOSE_PY)
BEST = """SELECT target_id, cast(CASE WHEN trivy THEN 1 WHEN npm AND locked THEN 2 END AS INTEGER) AS best FROM (
    SELECT o.target_id, coalesce(bool_or(r.source = 'trivy' AND json_valid(r.json)), false) AS trivy, coalesce(bool_or(r.source = 'npm-audit' AND json_valid(r.json)), false) AS npm,
      bool_or(l.target_id IS NOT NULL) AS locked
    FROM (SELECT DISTINCT target_id FROM manifests) o LEFT JOIN reports r ON r.target_id = o.target_id
    LEFT JOIN (SELECT DISTINCT target_id FROM manifests WHERE path = 'package-lock.json') l ON l.target_id = o.target_id GROUP BY o.target_id) WHERE trivy OR (npm AND locked)"""
ORACLES["best_sources"] = with_("SELECT * FROM best", "manifests", "reports", best=BEST)
ORACLES["source_cascade"] = with_(f"""SELECT target_id, scanner, count(*) AS n FROM (
    SELECT t.target_id, 'trivy' AS scanner FROM t JOIN best b ON b.target_id = t.target_id AND b.best = 1
    UNION ALL SELECT n.target_id, 'npm-audit' AS scanner FROM n JOIN best b ON b.target_id = n.target_id AND b.best = 2
    UNION ALL SELECT target_id, 'deps' AS scanner FROM ({_BUILT_IN}) WHERE target_id NOT IN (SELECT target_id FROM best)) GROUP BY ALL""",
                                  "items", "manifests", "reports", d=DEPS, nolock=NO_LOCK, reqs=REQS, loose=LOOSE_PY, best=BEST, t=TRIVY_RAW, n=NPM)
# The root manifests of the derived files are few, so their findings are told
# by what was planted: per target two npm findings, maybe a missing lock file,
# and the loose requirements.
_ROOT = "SELECT DISTINCT target_id FROM files WHERE path = 'package.json' AND starts_with(content, '{\"')"
_ROOT_FOUND = """SELECT target_id, 'deps' AS scanner, 'package.json' AS file, cast(NULL AS INTEGER) AS line, unnest(['unpinned-npm', 'unpinned-npm', 'git-dependency']) AS rule_id FROM root
    UNION ALL SELECT target_id, 'deps' AS scanner, 'package.json' AS file, NULL AS line, 'missing-lockfile' AS rule_id FROM root
      WHERE target_id NOT IN (SELECT target_id FROM files WHERE path IN ('package-lock.json', 'yarn.lock', 'pnpm-lock.yaml'))
    UNION ALL SELECT target_id, 'deps' AS scanner, 'requirements.txt' AS file, unnest([1, 5]) AS line, 'unpinned-python' AS rule_id FROM files WHERE path = 'requirements.txt'"""
ORACLES["select_scanners"] = with_("SELECT * FROM found", "files", root=_ROOT, found=_ROOT_FOUND)

# Web
MAIN = "SELECT * FROM exchanges WHERE kind = 'main' AND status IS NOT NULL"


def web_rows(test: str, rule_id: str, severity: str, extra: str = "", source: str = "main_pages", category: str = "config") -> str:
    return f"SELECT target_id, {quote(rule_id)} AS rule_id, {quote(severity)} AS severity, {quote(category)} AS category{extra} FROM {source} WHERE {test}"


_TITLES = {r.id: r.title for r in web.HEADER_RULES}
_HEADER_TESTS = {
    "missing-hsts": "h_hsts IS NULL", "missing-csp": "h_csp IS NULL", "missing-nosniff": "h_nosniff IS NULL",
    "missing-frame-guard": "h_frame IS NULL AND NOT contains(coalesce(h_csp, ''), 'frame-ancestors')",
    "missing-referrer-policy": "h_referrer IS NULL", "missing-permissions-policy": "h_permissions IS NULL",
}
_SEVERITY = {r.id: r.severity for r in web.HEADER_RULES + web.LEAK_RULES} | {p.id: p.severity for p in web.PROBES}
for _id, _test in _HEADER_TESTS.items():
    ORACLES[_id.replace("-", "_")] = with_(web_rows(_test, _id, _SEVERITY[_id], f", {quote(_TITLES[_id])} AS title"), "exchanges", main_pages=MAIN)
_LEAK_TESTS = {"leaky-server": ("regexp_matches(h_server, '[0-9]')", "h_server"), "leaky-powered-by": ("h_powered <> ''", "h_powered"), "leaky-aspnet": ("h_aspnet <> ''", "h_aspnet")}
for _rule in web.LEAK_RULES:
    _test, _col = _LEAK_TESTS[_rule.id]
    ORACLES[_rule.id.replace("-", "_")] = with_(
        web_rows(_test, _rule.id, "low", f", concat({quote(_rule.description + ' Value: ' + chr(34))}, {_col}, '\"') AS description"), "exchanges", main_pages=MAIN)
COOKIES = f"""SELECT target_id, cast(pos AS INTEGER) AS seq, cookie, coalesce(nullif({trim_js("string_split(cookie, '=')[1]")}, ''), 'unknown') AS name FROM (
    SELECT target_id, unnest(cs) AS cookie, unnest(range(0, len(cs))) AS pos FROM (SELECT target_id, list_filter([cookie_1, cookie_2], lambda c: c IS NOT NULL) AS cs FROM main_pages))"""
IS_SESSION = "(" + " OR ".join(f"contains(lower(name), '{w}')" for w in ("session", "sess", "sid", "token", "auth", "jwt", "access", "refresh", "csrf", "xsrf")) + ")"
ORACLES["explode_cookies"] = with_("SELECT * FROM cookies", "exchanges", main_pages=MAIN, cookies=COOKIES)
ORACLES["is_session_cookie"] = with_(f"SELECT target_id, name, {IS_SESSION} AS is_session FROM cookies", "exchanges", main_pages=MAIN, cookies=COOKIES)
_COOKIE = {
    "cookie-no-secure": ("NOT contains(lower(cookie), 'secure')", "medium", "concat('Cookie \"', name, '\" without Secure')"),
    "cookie-no-httponly": (f"NOT contains(lower(cookie), 'httponly') AND {IS_SESSION}", "medium", "concat('Session cookie \"', name, '\" without HttpOnly')"),
    "cookie-no-samesite": ("NOT contains(lower(cookie), 'samesite')", "low", "concat('Cookie \"', name, '\" without SameSite')"),
}
for _id, (_test, _sev, _title) in _COOKIE.items():
    ORACLES[_id.replace("-", "_")] = with_(web_rows(_test, _id, _sev, f", {_title} AS title", "cookies"), "exchanges", main_pages=MAIN, cookies=COOKIES)
_CORS = {
    "cors-wildcard-credentials": ("h_origin = '*' AND coalesce(h_credentials, '') = 'true'", "critical", "Every origin allowed with credentials"),
    "cors-wildcard-origin": ("h_origin = '*' AND coalesce(h_credentials, '') <> 'true'", "low", "Every origin allowed"),
}
ORACLES["cors_wildcard_credentials"] = with_(web_rows(_CORS["cors-wildcard-credentials"][0], "cors-wildcard-credentials", "critical", ", 'Every origin allowed with credentials' AS title"),
                                             "exchanges", main_pages=MAIN)
ORACLES["cors_wildcard"] = with_(web_rows(_CORS["cors-wildcard-origin"][0], "cors-wildcard-origin", "low", ", 'Every origin allowed' AS title"), "exchanges", main_pages=MAIN)
_MIXED = """(?i)(?:src|href|action)=["'']http://[^"'']+["'']"""
MIXED = f"""SELECT *, list_filter(regexp_extract_all(body, '{_MIXED}'), lambda a: NOT contains(a, 'http://schemas.') AND NOT contains(a, 'http://www.w3.org/')) AS res
    FROM (SELECT * FROM exchanges WHERE kind = 'main')"""
_MIXED_TEST = "status IS NOT NULL AND starts_with(url, 'https://') AND len(res) > 0"
ORACLES["mixed_content"] = with_(web_rows(_MIXED_TEST, "mixed-content", "medium", """, concat('Mixed content: ', len(res), ' plain HTTP addresses') AS title,
    concat('The page loads over plain HTTP: ', array_to_string(res[1:3], ', ')) AS description""", "mixed"), "exchanges", mixed=MIXED)
ORACLES["first_n_examples"] = with_("SELECT target_id, cast(len(res) AS INTEGER) AS n, array_to_string(res[1:3], ' ') AS examples FROM mixed", "exchanges", mixed=MIXED)
_NO_REDIRECT = "kind = 'http_head' AND status IS NOT NULL AND starts_with(url, 'https://') AND NOT starts_with(coalesce(h_location, ''), 'https://')"
ORACLES["no_https_redirect"] = with_(web_rows(_NO_REDIRECT, "no-https-redirect", "high", ", 'Plain HTTP is not redirected' AS title", "exchanges"), "exchanges")
UNITS = "(length(body) + len(regexp_extract_all(body, '[\\x{10000}-\\x{10FFFF}]')))"
BASELINE = f"SELECT target_id, cast({UNITS} AS INTEGER) AS baseline FROM exchanges WHERE kind = 'missing_page' AND status IS NOT NULL"
ORACLES["soft404_baseline"] = with_("SELECT * FROM base", "exchanges", base=BASELINE)
_BODY = {
    "probe-wp-admin": "contains(body, 'wp-login') OR contains(body, 'WordPress') OR contains(body, 'wp-admin')",
    "probe-phpinfo": "contains(body, 'phpinfo') OR contains(body, 'PHP Version')",
    "probe-server-status": "contains(body, 'Apache Server Status') OR contains(body, 'Server uptime')",
    "probe-debug": "contains(body, 'debug') AND NOT contains(body, '<!doctype')",
    "probe-graphql": "contains(body, '\"data\"') OR contains(body, '\"errors\"') OR contains(body, 'GraphQL')",
}
PROBED = f"""SELECT e.*, {UNITS} AS units, ltrim(body, ' ' || chr(9) || chr(10) || chr(13)) AS start, coalesce(b.baseline, 0) AS baseline FROM exchanges e
    LEFT JOIN base b ON b.target_id = e.target_id WHERE kind = 'probe' AND status = 200"""
_GENERIC = "units >= 10 AND NOT starts_with(start, '<!') AND NOT starts_with(start, '<html') AND NOT (baseline > 0 AND abs(units - baseline) < 100)"


def probe_rows(p) -> str:
    return web_rows(f"path = {quote(p.path)} AND ({_BODY.get(p.id, _GENERIC)})", p.id, p.severity, f", {quote(p.path)} AS file", "probed", p.category)


for _p in web.PROBES:
    ORACLES[_p.id.replace("-", "_")] = with_(probe_rows(_p), "exchanges", base=BASELINE, probed=PROBED)
_PROBE_ALL = " UNION ALL ".join(probe_rows(p) for p in web.PROBES)
ORACLES["probe_response_baseline_join"] = with_(f"SELECT target_id, rule_id, file FROM ({_PROBE_ALL})", "exchanges", base=BASELINE, probed=PROBED)
_WORDS = " OR ".join(f"contains(lower(p), '{w}')" for w in ("/admin", "/api", "/internal", "/secret", "/private", "/dashboard", "/panel", "/staging", "/backup", "/db", "/config", "/debug"))
ROBOTS = f"""SELECT target_id, list_filter(list_transform(list_filter(string_split(body, chr(10)), lambda l: starts_with(lower({trim_js('l')}), 'disallow:')),
    lambda l: {trim_js("substr(l, strpos(l, ':') + 1)")}), lambda p: p <> '' AND ({_WORDS})) AS paths
    FROM exchanges WHERE kind = 'robots' AND status = 200 AND body <> '' AND NOT contains(body, '<!DOCTYPE')"""
ORACLES["robots_sensitive_paths"] = with_(web_rows("len(paths) > 0", "robots-sensitive-paths", "low",
                                                   ", concat('The file points at: ', array_to_string(paths[1:5], ', ')) AS description", "robots"), "exchanges", robots=ROBOTS)
NO_SECURITY = """SELECT m.target_id FROM main_pages m LEFT JOIN exchanges s ON s.target_id = m.target_id AND s.kind = 'security_txt' AND s.status = 200 WHERE s.target_id IS NULL"""
ORACLES["missing_security_txt"] = with_(web_rows("true", "missing-security-txt", "low", ", 'No security.txt' AS title", "nosec"), "exchanges", main_pages=MAIN, nosec=NO_SECURITY)
_REQUIRED = {"strict-transport-security": "h_hsts", "content-security-policy": "h_csp", "x-content-type-options": "h_nosniff", "x-frame-options": "h_frame",
             "referrer-policy": "h_referrer", "permissions-policy": "h_permissions"}
ORACLES["headers_anti_join_required"] = with_(" UNION ALL ".join(f"SELECT target_id, '{h}' AS header FROM main_pages WHERE {c} IS NULL" for h, c in _REQUIRED.items()),
                                              "exchanges", main_pages=MAIN)
ORACLES["web_scan_errors"] = with_("SELECT target_id, 'web' AS scanner, 'main page not reached' AS error FROM exchanges WHERE kind = 'main' AND status IS NULL", "exchanges")
_WEB_PARTS = (
    [web_rows(t, i, _SEVERITY[i]) for i, t in _HEADER_TESTS.items()] + [web_rows(t, i, "low") for i, (t, _) in _LEAK_TESTS.items()]
    + [web_rows(t, i, s, source="cookies") for i, (t, s, _) in _COOKIE.items()] + [web_rows(t, i, s) for i, (t, s, _) in _CORS.items()]
    + [web_rows(_MIXED_TEST, "mixed-content", "medium", source="mixed"), web_rows(_NO_REDIRECT, "no-https-redirect", "high", source="exchanges"),
       f"SELECT target_id, rule_id, severity, category FROM ({_PROBE_ALL})", web_rows("len(paths) > 0", "robots-sensitive-paths", "low", source="robots"),
       web_rows("true", "missing-security-txt", "low", source="nosec")])
WEB_CTES = dict(main_pages=MAIN, cookies=COOKIES, mixed=MIXED, base=BASELINE, probed=PROBED, robots=ROBOTS, nosec=NO_SECURITY, web_found=" UNION ALL ".join(_WEB_PARTS))
ORACLES["scan_web"] = with_("SELECT * FROM web_found WHERE target_id IN (SELECT target_id FROM main_pages)", "exchanges", **WEB_CTES)
_UNION = f"""SELECT target_id, 'sast' AS scanner, severity FROM ({_CODE_FOUND})
    UNION ALL SELECT target_id, 'deps' AS scanner, CASE WHEN rule_id = 'unpinned-python' THEN 'low' ELSE 'medium' END AS severity FROM found
    UNION ALL SELECT target_id, 'secrets' AS scanner, severity FROM ({ALL_SECRETS})
    UNION ALL {" UNION ALL ".join(f"SELECT target_id, 'web' AS scanner, {quote(s)} AS severity FROM main_pages WHERE {t}" for t, s, _ in _CORS.values())}"""
ORACLES["union_scanners"] = with_(f"SELECT target_id, scanner, severity, count(*) AS n FROM ({_UNION}) GROUP BY ALL", "files", "exchanges", **scan_ctes(RULES), meta=RULE_META, env=ENV,
                                  root=_ROOT, found=_ROOT_FOUND, sfiles=SFILES, slines=SLINES, main_pages=MAIN)
_ALL_FILES = "SELECT target_id, path, size_bytes, content FROM files UNION ALL SELECT target_id, path, size_bytes, content FROM manifests"
_FULL = f"""SELECT target_id, category, severity FROM ({_CODE_FOUND})
    UNION ALL SELECT target_id, 'code' AS category, {SEMGREP_SEV} AS severity FROM (
      SELECT *, row_number() OVER (PARTITION BY target_id, file, nullif(raw_line, 0), coalesce(nullif(check_id, ''), 'Code issue') ORDER BY seq) AS rn FROM sem) WHERE rn = 1
    UNION ALL SELECT target_id, category, severity FROM secret_rows
    UNION ALL SELECT t.target_id, 'dependency' AS category, {TRIVY_SEV} AS severity FROM tri t JOIN best b ON b.target_id = t.target_id AND b.best = 1
    UNION ALL SELECT n.target_id, 'dependency' AS category, {NPM_SEV} AS severity FROM npm n JOIN best b ON b.target_id = n.target_id AND b.best = 2
    UNION ALL SELECT target_id, 'dependency' AS category, CASE WHEN rule_id = 'unpinned-python' THEN 'low' ELSE 'medium' END AS severity
      FROM ({_BUILT_IN}) WHERE target_id NOT IN (SELECT target_id FROM best)
    UNION ALL SELECT target_id, 'dependency' AS category, CASE WHEN rule_id = 'unpinned-python' THEN 'low' ELSE 'medium' END AS severity FROM root_found
    UNION ALL SELECT target_id, category, severity FROM web_found WHERE target_id IN (SELECT target_id FROM main_pages)"""
ORACLES["full_scan"] = with_(
    f"""SELECT s.target_id, t.scan_type, s.score, s.grade, s.total, cast(CASE WHEN t.scan_type = 'web' THEN 0 ELSE coalesce(c.scanned_files, 0) END AS BIGINT) AS scanned_files
    FROM scores s JOIN all_targets t ON t.target_id = s.target_id
    LEFT JOIN (SELECT target_id, count(*) FILTER (WHERE {COUNTED}) AS scanned_files FROM all_files GROUP BY target_id) c ON c.target_id = s.target_id""",
    "files", "items", "manifests", "reports", "exchanges", **scan_ctes(RULES), meta=RULE_META, env=ENV, sem=SEMGREP, all_files=_ALL_FILES,
    sfiles=f"SELECT target_id, path, content FROM all_files WHERE {SECRET_FILES}", slines=SLINES, secret_rows=f"SELECT target_id, category, severity FROM ({ALL_SECRETS})",
    d=DEPS, nolock=NO_LOCK, reqs=REQS, loose=LOOSE_PY, best=BEST, tri=TRIVY_RAW, npm=NPM, root=_ROOT, root_found=_ROOT_FOUND, **WEB_CTES,
    all_targets="""SELECT target_id, min(scan_type) AS scan_type FROM (SELECT target_id, 'code' AS scan_type FROM all_files
      UNION ALL SELECT target_id, 'web' AS scan_type FROM exchanges WHERE target_id NOT IN (SELECT target_id FROM exchanges WHERE kind = 'main' AND status IS NULL)) GROUP BY target_id""",
    **scored_ctes(_FULL, "SELECT target_id FROM all_targets"))

assert set(ORACLES) <= set(QUERIES), sorted(set(ORACLES) - set(QUERIES))
