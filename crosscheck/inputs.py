"""Derived inputs, as SQL both engines run; the few spellings that differ are
in ``Dialect``. Inputs only: no check is stated here."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from argusframe.sources.tables import lower_header_names
from crosscheck.snippets import SNIPPETS

TABLES = ("documents", "pages", "lineitem", "part", "orders", "events")


@dataclass(frozen=True)
class Dialect:
    name: str

    def array(self, items: list[str]) -> str:
        body = ", ".join(items)
        return f"array({body})" if self.name == "spark" else f"[{body}]"

    def at(self, array: str, index: str) -> str:
        f = "element_at" if self.name == "spark" else "list_extract"
        return f"{f}({array}, cast({index} AS INT))"

    def explode(self, array: str) -> str:
        return f"explode({array})" if self.name == "spark" else f"unnest({array})"

    def octets(self, text: str) -> str:
        return f"cast(octet_length({text}) AS BIGINT)" if self.name == "spark" else f"octet_length(encode({text}))"

    def joined(self, text: str, order: str, separator: str = "','") -> str:
        if self.name == "spark":
            return f"listagg({text}, {separator}) WITHIN GROUP (ORDER BY {order})"
        return f"string_agg({text}, {separator} ORDER BY {order})"


SPARK, DUCK = Dialect("spark"), Dialect("duck")


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


EXTENSIONS = [".js", ".ts", ".jsx", ".tsx", ".py", ".go", ".java", ".py"]


def docs(d: Dialect) -> str:
    """Documents with their target; a third of all belong to one."""
    return """SELECT doc_id, text, lang, cast(floor(doc_id / 24) AS BIGINT) AS block,
        CASE WHEN doc_id % 3 = 2 THEN 'mono' ELSE concat('repo-', cast(cast(floor(doc_id / 24) AS BIGINT) AS VARCHAR(20))) END AS target_id
        FROM documents"""


def files(d: Dialect) -> str:
    """Source files from documents and root files per target."""
    snippets = d.array([quote(s) for s in SNIPPETS])
    n = len(SNIPPETS)
    pick = [d.at(snippets, f"({i}) % {n} + 1") for i in ("doc_id", "doc_id * 7 + 3", "doc_id * 13 + 5")]
    ext = d.at(d.array([quote(e) for e in EXTENSIONS]), "doc_id % 8 + 1")
    names = d.array([quote(x) for x in (".env", ".gitignore", "package.json", "package-lock.json", "yarn.lock", "requirements.txt")])
    return f"""
    WITH docs AS ({docs(d)}),
    texts AS (
      SELECT target_id, doc_id,
        concat(CASE WHEN doc_id % 11 = 3 THEN 'node_modules/' WHEN doc_id % 13 = 5 THEN '.hidden/'
                    WHEN doc_id % 17 = 2 THEN 'a/b/c/d/e/f/g/h/i/j/' WHEN doc_id % 17 = 4 THEN 'a/b/c/d/e/f/g/h/i/'
                    WHEN doc_id % 19 = 4 THEN 'spec/' WHEN doc_id % 19 = 6 THEN '.github/.gitignore/'
                    ELSE concat('src/', lang, '/') END,
               CASE WHEN doc_id % 29 = 3 THEN '.env.' ELSE 'f' END, cast(doc_id AS VARCHAR(20)),
               CASE WHEN doc_id % 31 = 3 THEN upper({ext}) ELSE {ext} END) AS path,
        concat(text, chr(10), replace(replace(replace(concat({pick[0]}, '¶', {pick[1]}, '¶', {pick[2]}), '¶', chr(10)), '¤', chr(13)), '§', chr(36))) AS content
      FROM docs),
    roots AS (
      SELECT target_id, block, {d.explode(names)} AS path
      FROM (SELECT target_id, min(block) AS block FROM docs GROUP BY target_id) r)
    SELECT target_id, path,
      CASE WHEN doc_id % 23 = 7 THEN 1048577 WHEN doc_id % 23 = 8 THEN 1048576 ELSE {d.octets("content")} END AS size_bytes, content
    FROM texts
    UNION ALL
    SELECT target_id, path, {d.octets("content")} AS size_bytes, content FROM (
      SELECT target_id, path, replace(CASE
          WHEN path = '.env' THEN 'KEY=value'
          WHEN path = '.gitignore' THEN CASE WHEN block % 3 = 0 THEN 'node_modules¶dist' ELSE 'dist¶.env*' END
          WHEN path = 'package.json' THEN CASE WHEN block % 7 = 3 THEN '{{broken'
               ELSE concat('{{"name":"r', cast(block AS VARCHAR(20)), '","dependencies":{{"left-pad":"*","express":"^4.0.0"}},"devDependencies":{{"express":"latest","tool":"git+ssh://h/t"}}}}') END
          WHEN path = 'requirements.txt' THEN 'flask¶# note¶¶django==4.0¶numpy<2¶ pip~=1 '
          ELSE '{{}}' END, '¶', chr(10)) AS content
      FROM roots
      WHERE (path = '.env' AND block % 2 = 0) OR (path = '.gitignore' AND block % 3 <> 1)
         OR (path = 'package.json' AND block % 5 <> 4) OR (path = 'package-lock.json' AND block % 4 = 1)
         OR (path = 'yarn.lock' AND block % 6 = 5) OR (path = 'requirements.txt' AND block % 2 = 1)) q"""


def items(d: Dialect) -> str:
    """Packages of each order with a version each."""
    versions = d.array([quote(v) for v in ("*", "latest", "^1.2.3", "git+ssh://git@host/x.git", "https://github.com/a/b", "~2.0", "5", "1.0.0")])
    return f"""SELECT l_orderkey AS ord, l_linenumber AS num, l_suppkey AS sup, l_quantity AS qty, l_extendedprice AS price, l_partkey AS partkey,
        concat(replace(p_name, ' ', '-'), '-', cast(l_partkey AS VARCHAR(20))) AS package,
        l_linenumber % 3 = 0 AS is_dev, (l_partkey + l_linenumber) % 8 AS kind,
        {d.at(versions, "(l_partkey + l_linenumber) % 8 + 1")} AS version
        FROM lineitem JOIN part ON l_partkey = p_partkey"""


_PLACE = "num, sup, qty, price, package"


def manifests(d: Dialect) -> str:
    """Root files of one target per order."""
    entry = "concat('\"', package, '\":', CASE WHEN kind = 6 THEN version ELSE concat('\"', version, '\"') END)"
    line = """CASE num % 8 WHEN 0 THEN package WHEN 1 THEN concat(package, '==1.0') WHEN 2 THEN concat(package, '<2')
              WHEN 3 THEN concat(package, '!=1') WHEN 4 THEN concat('# ', package) WHEN 5 THEN ' '
              WHEN 6 THEN concat('-r ', package, '.txt') ELSE concat('  ', package, chr(9), '; python_version>=''3''') END"""
    names = d.array(["'package.json'", "'requirements.txt'", "'package-lock.json'", "'pnpm-lock.yaml'"])
    return f"""
    WITH items AS ({items(d)}),
    per_order AS (
      SELECT ord, {d.joined(f"CASE WHEN is_dev THEN NULL ELSE {entry} END", _PLACE)} AS main,
        {d.joined(f"CASE WHEN is_dev THEN {entry} END", _PLACE)} AS dev,
        {d.joined(line, _PLACE, "chr(10)")} AS reqs
      FROM items GROUP BY ord),
    named AS (SELECT ord, main, dev, reqs, {d.explode(names)} AS path FROM per_order)
    SELECT target_id, path, {d.octets("content")} AS size_bytes, content FROM (
      SELECT concat('order-', cast(ord AS VARCHAR(20))) AS target_id, path,
        CASE path WHEN 'package.json' THEN CASE WHEN ord % 29 = 0 THEN '{{broken' ELSE
               concat('{{"name":"o","dependencies":{{', coalesce(main, ''), '}},"devDependencies":{{', coalesce(dev, ''), '}}}}') END
             WHEN 'requirements.txt' THEN reqs ELSE '{{}}' END AS content
      FROM named
      WHERE path IN ('package.json', 'requirements.txt') OR (path = 'package-lock.json' AND ord % 3 = 0)
         OR (path = 'pnpm-lock.yaml' AND ord % 5 = 0)) q"""


def reports(d: Dialect) -> str:
    """Reports of three tools; some orders have several, some none."""
    sev = lambda values: d.at(d.array([quote(v) for v in values]), f"(partkey + num) % {len(values)} + 1")
    pk, num = "cast(partkey AS VARCHAR(20))", "cast(num - 1 AS VARCHAR(20))"
    semgrep = f"""concat('{{"check_id":"rules.web.check-', {pk}, '","path":"src/f', {pk}, '.js","start":{{"line":', {num}, '}}',
        CASE WHEN partkey % 5 = 0 THEN '' ELSE concat(',"extra":{{"severity":"', {sev(["ERROR", "warning", "INFO", "NOTE"])}, '","message":"',
          CASE WHEN partkey % 7 = 0 THEN '' ELSE concat('seen in ', package) END, '","fix":"', CASE WHEN partkey % 3 = 0 THEN 'use x' ELSE '' END, '"}}') END, '}}')"""
    trivy = f"""concat('{{"VulnerabilityID":"CVE-2024-', {pk}, '","PkgName":"', package, '","InstalledVersion":"', {num}, '.0"',
        CASE WHEN partkey % 3 = 0 THEN '' ELSE concat(',"FixedVersion":"', cast(num AS VARCHAR(20)), '.1"') END,
        CASE WHEN partkey % 5 = 0 THEN '' ELSE concat(',"Severity":"', {sev(["CRITICAL", "High", "medium", "LOW", "UNKNOWN"])}, '"') END,
        CASE WHEN partkey % 4 = 0 THEN ',"Title":""' WHEN partkey % 4 = 1 THEN ',"Title":"flaw"' ELSE '' END,
        CASE WHEN partkey % 8 = 0 THEN ',"Description":"long text"' ELSE '' END, '}}')"""
    npm = f"""concat('"', package, '":{{"severity":"', {sev(["critical", "high", "moderate", "low", "info"])}, '","via":[',
        CASE WHEN partkey % 3 = 0 THEN '"other"' WHEN partkey % 3 = 1 THEN '{{"title":"Bad parse"}}' ELSE '{{"title":""}}' END, '],"fixAvailable":',
        CASE WHEN partkey % 4 = 0 THEN 'false' WHEN partkey % 4 = 1 THEN '{{"name":"y"}}' ELSE 'true' END, '}}')"""
    place = "num, partkey"
    return f"""
    WITH items AS ({items(d)}),
    unique_items AS (SELECT ord, partkey, package, min(num) AS num FROM items GROUP BY ord, partkey, package),
    agg AS (SELECT ord, {d.joined(semgrep, place)} AS semgrep, {d.joined(trivy, place)} AS trivy, {d.joined(npm, place)} AS npm
      FROM unique_items GROUP BY ord),
    named AS (SELECT ord, semgrep, trivy, npm, {d.explode(d.array(["'semgrep'", "'trivy'", "'npm-audit'"]))} AS source FROM agg)
    SELECT concat('order-', cast(ord AS VARCHAR(20))) AS target_id, source,
      CASE source WHEN 'semgrep' THEN CASE WHEN ord % 31 = 0 THEN '{{"version":"1"}}' ELSE concat('{{"results":[', semgrep, ']}}') END
        WHEN 'trivy' THEN CASE WHEN ord % 31 = 1 THEN '{{"Results":[]}}' WHEN ord % 31 = 2 THEN '{{oops'
             ELSE concat('{{"Results":[{{"Target":"', CASE WHEN ord % 2 = 0 THEN 'package-lock.json' ELSE '' END, '","Vulnerabilities":[', trivy, ']}},{{"Target":"none"}}]}}') END
        ELSE concat('{{"vulnerabilities":{{', npm, '}}}}') END AS json
    FROM named
    WHERE (source = 'semgrep' AND ord % 4 = 2) OR (source = 'trivy' AND ord % 4 = 0) OR (source = 'npm-audit' AND ord % 4 IN (0, 1))"""


KINDS = (
    ["main|/", "http_head|/", "missing_page|/missing", "robots|/robots.txt", "security_txt|/.well-known/security.txt"]
    + [f"probe|{p}" for p in ("/.env", "/.git/config", "/.git/HEAD", "/.env.local", "/.env.production", "/wp-admin/", "/phpinfo.php",
                              "/server-status", "/debug", "/.DS_Store", "/api/docs", "/swagger.json", "/graphql")]
)


def exchanges(d: Dialect) -> str:
    """Captured exchanges of one target per page, headers as columns."""
    kinds = d.array([quote(f"{i}|{k}") for i, k in enumerate(KINDS)])
    marks = d.array([quote(m) for m in ("see wp-login.php", "PHP Version 8", "Server uptime: 3", "debug <!DOCTYPE", "debug <!doctype",
                                        "{\"data\":1}", "GraphQL", "phpinfo()", "WordPress")])
    return f"""
    WITH named AS (SELECT page_id, url AS page_url, html, {d.explode(kinds)} AS k FROM pages),
    split AS (SELECT page_id, page_url, html, cast(split_part(k, '|', 1) AS INT) AS idx, split_part(k, '|', 2) AS kind, split_part(k, '|', 3) AS path,
      page_id * 7 + cast(split_part(k, '|', 1) AS INT) * 3 AS h FROM named)
    SELECT concat('site-', cast(page_id AS VARCHAR(20))) AS target_id,
      CASE WHEN page_id % 4 = 3 THEN concat('http://s', cast(page_id AS VARCHAR(20)), '.example') ELSE concat('https://s', cast(page_id AS VARCHAR(20)), '.example') END AS url,
      path, kind, page_id,
      CASE WHEN kind = 'http_head' THEN 'HEAD' ELSE 'GET' END AS method,
      CASE WHEN kind = 'main' AND page_id % 37 = 5 THEN NULL WHEN kind IN ('http_head', 'missing_page') AND page_id % 9 = 4 THEN NULL
           WHEN kind = 'missing_page' THEN CASE WHEN page_id % 2 = 0 THEN 404 ELSE 200 END
           WHEN kind = 'main' THEN 200 WHEN h % 5 = 4 THEN 404 ELSE 200 END AS status,
      CASE kind
        WHEN 'main' THEN CASE page_id % 4 WHEN 0 THEN html
             WHEN 1 THEN concat(html, '<script src="http://cdn.example/a.js"></script><a HREF=''http://b.example/''>x</a>')
             WHEN 2 THEN concat(html, '<svg href="http://www.w3.org/2000/svg"></svg><img src="http://schemas.example/x">')
             ELSE concat(html, '<img src="http://i.example/1"><img src="http://i.example/2"><img src="http://i.example/3"><form action="http://i.example/4">') END
        WHEN 'missing_page' THEN CASE WHEN page_id % 5 = 0 THEN '' ELSE repeat('n', cast(150 + page_id % 50 AS INT)) END
        WHEN 'robots' THEN replace(CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'User-agent: *¶Disallow: /Admin/¶ DISALLOW: /x:/api ¶Disallow:'
             WHEN 2 THEN '<!DOCTYPE html>¶Disallow: /admin' WHEN 3 THEN 'Disallow: /public'
             ELSE 'disallow: /admin¶disallow: /api¶disallow: /db¶disallow: /panel¶disallow: /staging¶disallow: /debug' END, '¶', chr(10))
        WHEN 'probe' THEN CASE h % 9 WHEN 0 THEN 'DB_PASSWORD=swordfish' WHEN 1 THEN 'tiny' WHEN 2 THEN concat(chr(10), ' <!DOCTYPE html><p>app</p>')
             WHEN 3 THEN '<html><body>app</body></html>' WHEN 4 THEN repeat('x', cast(150 + page_id % 50 + 99 AS INT))
             WHEN 5 THEN repeat('x', cast(150 + page_id % 50 + 100 AS INT)) WHEN 6 THEN repeat('😀', 5) ELSE {d.at(marks, "(cast(floor(page_id / 9) AS BIGINT) + idx) % 9 + 1")} END
        ELSE 'Contact: mailto:a@b.example' END AS body,
      CASE WHEN kind = 'main' AND page_id % 2 = 0 THEN 'max-age=1' END AS h_hsts,
      CASE WHEN kind = 'main' THEN CASE page_id % 3 WHEN 0 THEN 'default-src self' WHEN 1 THEN 'frame-ancestors none' END END AS h_csp,
      CASE WHEN kind = 'main' AND page_id % 5 < 3 THEN 'nosniff' END AS h_nosniff,
      CASE WHEN kind = 'main' AND page_id % 7 < 2 THEN 'DENY' END AS h_frame,
      CASE WHEN kind = 'main' AND page_id % 11 < 5 THEN 'no-referrer' END AS h_referrer,
      CASE WHEN kind = 'main' AND page_id % 13 < 5 THEN 'camera=()' END AS h_permissions,
      CASE WHEN kind = 'main' THEN CASE page_id % 3 WHEN 0 THEN 'nginx' WHEN 1 THEN 'nginx/1.25' END END AS h_server,
      CASE WHEN kind = 'main' THEN CASE page_id % 4 WHEN 0 THEN 'Express' WHEN 1 THEN '' END END AS h_powered,
      CASE WHEN kind = 'main' AND page_id % 6 = 1 THEN '4.0' END AS h_aspnet,
      CASE WHEN kind = 'main' THEN CASE WHEN page_id % 5 < 2 THEN '*' WHEN page_id % 5 = 2 THEN 'https://a.example' END END AS h_origin,
      CASE WHEN kind = 'main' THEN CASE page_id % 2 WHEN 0 THEN 'true' ELSE 'false' END END AS h_credentials,
      CASE WHEN kind = 'http_head' THEN CASE page_id % 3 WHEN 0 THEN 'https://x.example/' WHEN 1 THEN 'http://x.example/' END END AS h_location,
      CASE WHEN kind = 'main' THEN CASE page_id % 6 WHEN 0 THEN 'sid=1; Secure; HttpOnly; SameSite=Lax' WHEN 1 THEN 'AuthToken=abc; Path=/' WHEN 2 THEN '__Secure-theme=dark'
           WHEN 3 THEN '=x' WHEN 4 THEN ' lang = en; samesite=None' END END AS cookie_1,
      CASE WHEN kind = 'main' AND page_id % 4 = 1 THEN 'XSRF-TOKEN=q; secure' END AS cookie_2
    FROM split"""


def site_targets(d: Dialect) -> str:
    """Addresses as users type them."""
    variants = ["page_url", "concat(' ', page_url, '/// ')", "replace(page_url, 'http', 'HTTP')", "split_part(page_url, '://', 2)", "concat('./dir', pid)",
                "concat('app', pid, '.js')", "concat('localhost:', pid)", "concat('LOCALHOST/', pid)", "concat('http://127.0.0.1:8080/', pid)",
                "concat('10.0.0.8/', pid)", "concat('172.99.0.1/', pid)", "concat('192.168.1.1?', pid)", "concat('printer', pid, '.local')",
                "concat('169.254.1.1/', pid)", "concat('https://user:pw@Shop', pid, '.example:444/a')", "concat('http', pid, '.example')", "'https://'",
                "concat('0.0.0.0#', pid)", "concat('my project ', pid)", "concat('https://a', pid, '.example:99999/')"]
    cases = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(variants))
    return f"""SELECT concat('site-', pid) AS target_id, CASE page_id % {len(variants)} {cases} END AS target
        FROM (SELECT page_id, cast(page_id AS VARCHAR(20)) AS pid, url AS page_url FROM pages) p"""


def repo_targets(d: Dialect) -> str:
    variants = ["concat('github.com/own', pid, '/re po.git')", "concat('https://www.github.com/own', pid, '/r/tree/main?x=1')", "concat('gitlab.com/a/', pid)",
                "concat('github.com/only', pid)", "concat(' https://github.com/a+b', pid, '/c_d.e/// ')", "concat('http://GitHub.com/x', pid, '/y.git/')", "'http'",
                "concat('github.com//x', pid)", "concat('https://github.com/o', pid, '/r#readme')"]
    cases = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(variants))
    return f"""SELECT page_id, CASE page_id % {len(variants)} {cases} END AS target FROM (SELECT page_id, cast(page_id AS VARCHAR(20)) AS pid FROM pages) p"""


def requests(d: Dialect) -> str:
    """Scan requests in the order of events."""
    variants = ["concat('shop', eid, '.example')", "concat('10.1.2.3/', eid)", "concat('github.com/o', eid, '/r')", "concat('gitlab.com/o/', eid)",
                "concat('code', eid, '.zip')", "concat('code', eid, '.tar.gz')", "''"]
    cases = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(variants))
    return f"""SELECT event_id AS request_id,
      CASE event_type WHEN 'view' THEN 'website' WHEN 'click' THEN 'website' WHEN 'signup' THEN 'repo' WHEN 'purchase' THEN 'archive' ELSE 'other' END AS kind,
      CASE event_id % {len(variants)} {cases} END AS target, cast(floor(value * 1000000) AS BIGINT) AS size
      FROM (SELECT event_id, event_type, value, cast(event_id AS VARCHAR(20)) AS eid FROM events) e"""


def findings(d: Dialect) -> str:
    """Findings of many targets, a third of them in one."""
    pick = lambda values, by: d.at(d.array([quote(v) for v in values]), f"({by}) % {len(values)} + 1")
    return f"""SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'hot' ELSE concat('order-', cast(l_orderkey AS VARCHAR(20))) END AS target_id,
      {pick(["secrets", "deps", "sast", "semgrep", "web"], "l_suppkey")} AS scanner,
      {pick(["critical", "high", "medium", "low", "low", "info", "odd"], "l_linenumber + l_partkey")} AS severity,
      {pick(["secret", "code", "config", "dependency", "web", "other"], "l_partkey")} AS category,
      concat('Title <', cast(l_partkey % 50 AS VARCHAR(20)), '> & "q"') AS title,
      concat('It''s in ', cast(l_partkey AS VARCHAR(20))) AS description,
      CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE concat('src/f', cast(l_partkey % 97 AS VARCHAR(20)), '.js') END AS file,
      cast(CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_quantity END AS INT) AS line,
      'Fix it' AS recommendation,
      CASE WHEN l_suppkey % 5 = 4 THEN NULL ELSE concat('rule-', cast(l_partkey % 7 AS VARCHAR(20))) END AS rule_id,
      cast(NULL AS VARCHAR(20)) AS cve, cast(NULL AS VARCHAR(20)) AS installed_version, cast(NULL AS VARCHAR(20)) AS fixed_version,
      cast(CASE l_suppkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 3 ELSE 5 END AS INT) AS scanner_ord,
      cast(l_partkey % 7 AS INT) AS rule_ord, cast(floor(l_extendedprice) AS INT) AS seq
      FROM lineitem"""


def finding_targets(d: Dialect) -> str:
    """Every order is a target; those without lines have no findings."""
    return """SELECT concat('order-', cast(o_orderkey AS VARCHAR(20))) AS target_id FROM orders
        UNION ALL SELECT 'hot' AS target_id FROM (SELECT max(o_orderkey) AS m FROM orders) x"""


def stored_results(d: Dialect) -> str:
    """Result documents as read back, some fields absent."""
    return """SELECT concat('order-', cast(o_orderkey AS VARCHAR(20))) AS target_id,
      CASE WHEN o_orderkey % 17 = 0 THEN 'not json' ELSE concat('{"id":1',
        CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat(',"score":', cast(o_orderkey % 101 AS VARCHAR(20))) END,
        CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE ',"grade":"B"' END,
        CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE ',"findings":[{"title":"a"},{"title":"b"}]' END,
        CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE ',"scannedFiles":47,"duration":1.5' END,
        CASE WHEN o_orderkey % 2 = 0 THEN ',"scanType":"web"' ELSE '' END, '}') END AS json
      FROM orders"""


def archive_members(d: Dialect) -> str:
    """Members of one archive per block of documents, below a top folder."""
    return f"""SELECT concat('block-', cast(block AS VARCHAR(20))) AS target_id,
        concat(CASE doc_id % 6 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'src/_' WHEN 2 THEN 'lib/.hid/' ELSE 'src/' END, 'f', cast(doc_id AS VARCHAR(20)), '.js') AS path,
        {d.octets("text")} AS size_bytes, text AS content FROM ({docs(d)}) x"""


BUILDERS = {f.__name__: f for f in (
    docs, files, items, manifests, reports, exchanges, site_targets, repo_targets, requests, findings, finding_targets, stored_results,
    archive_members)}


_TEXT_TABLES = ("documents", "pages")
_TABLES: dict = {}
_STORED: dict[tuple[str, str], str] = {}


class Inputs:
    """The derived inputs as Spark DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        """A driver table; the look at its schema and splits is kept. The test
        tables are single small files, so their texts are dealt out to all cores here."""
        path = str(Path(self.sf_dir) / f"{name}.parquet")
        key = (self.spark.sparkContext.applicationId, path)
        if key not in _TABLES:
            scan = self.spark.read.parquet(path)
            _TABLES[key] = scan.schema, scan.rdd.getNumPartitions() < self.spark.sparkContext.defaultParallelism
        schema, few = _TABLES[key]
        scan = self.spark.read.schema(schema).parquet(path)
        return scan.repartition(self.spark.sparkContext.defaultParallelism) if few and name in _TEXT_TABLES else scan

    def derive(self, name: str) -> DataFrame:
        """A derived input; from its stored table if it was stored."""
        stored = _STORED.get((self.sf_dir, name))
        if stored:
            return self.spark.read.parquet(stored)
        sql = BUILDERS[name](SPARK)
        for table in TABLES:
            if f" {table}" in sql:
                self.table(table).createOrReplaceTempView(table)
        return self.spark.sql(sql)

    def store(self, name: str, folder: str) -> None:
        """Write a derived input as Parquet; later calls read it from there."""
        path = f"{folder}/{name}"
        self.derive(name).write.parquet(path)
        _STORED[(self.sf_dir, name)] = path

    def archives(self, kind: str) -> DataFrame:
        """One archive per block of 24 documents."""
        import io
        import tarfile
        import zipfile

        def pack(key, rows):
            import pandas as pd
            held = io.BytesIO()
            if kind == "zip":
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as out:
                    for path, content in zip(rows["path"], rows["content"]):
                        out.writestr(path, content.encode())
            else:
                with tarfile.open(fileobj=held, mode="w:gz") as out:
                    for path, content in zip(rows["path"], rows["content"]):
                        data = content.encode()
                        info = tarfile.TarInfo(f"top/{path}")
                        info.size = len(data)
                        out.addfile(info, io.BytesIO(data))
            raw = held.getvalue()
            suffix = "zip" if kind == "zip" else "tar.gz"
            return pd.DataFrame([{"path": f"/in/{key[0]}.{suffix}", "length": len(raw), "content": raw}])

        return self.derive("archive_members").groupBy("target_id").applyInPandas(
            pack, "path string, length bigint, content binary")

    @property
    def responses(self) -> DataFrame:
        """Exchanges with their headers as a map, in the case servers send."""
        flat = self.derive("exchanges")
        names = {
            "h_hsts": "Strict-Transport-Security", "h_csp": "Content-Security-Policy", "h_nosniff": "X-Content-Type-Options",
            "h_frame": "X-Frame-Options", "h_referrer": "Referrer-Policy", "h_permissions": "Permissions-Policy", "h_server": "Server",
            "h_powered": "X-Powered-By", "h_aspnet": "X-AspNet-Version", "h_origin": "Access-Control-Allow-Origin",
            "h_credentials": "Access-Control-Allow-Credentials", "h_location": "Location",
        }
        single = F.array(*[F.struct(F.lit(n).alias("key"), F.array(c).alias("value")) for c, n in names.items()])
        cookies = F.array_compact(F.array("cookie_1", "cookie_2"))
        entries = F.concat(
            F.filter(single, lambda e: F.get(e["value"], F.lit(0)).isNotNull()),
            F.filter(F.array(F.struct(F.lit("Set-Cookie").alias("key"), cookies.alias("value"))), lambda e: F.size(e["value"]) > 0))
        return lower_header_names(flat.select(
            "target_id", "url", "path", "kind", "method", "status", F.map_from_entries(entries).alias("headers"), "body"))


def store_files(rows: DataFrame, folder: str) -> None:
    """Write ``(path, content)`` as files below ``folder``, from where the rows are."""
    import pyarrow as pa

    from argusframe.sources.trees import open_store

    def write(batches):
        store, root = open_store(folder)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                place = f"{root}/{path.lstrip('/')}"
                store.create_dir(place.rpartition("/")[0])
                with store.open_output_stream(place) as out:
                    out.write(content or b"")
            yield pa.RecordBatch.from_pydict({"files": [len(batch)]})

    rows.select("path", "content").mapInArrow(write, "files bigint").agg({"files": "sum"}).collect()
