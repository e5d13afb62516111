"""Checks on captured web exchanges.

``responses`` holds one row per exchange of a target: ``kind`` is ``main``,
``http_head``, ``missing_page``, ``probe``, ``robots`` or ``security_txt``, and
``url`` is the normalised address of the target. Checks on the main page are
row-local and leave together as one generate; only the baseline of the probes
and the set of reachable targets are joined.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from argusframe.functions.text import first_present, message, trim_space, trim_start, utf16_length
from argusframe.operators.skew import salted_join
from argusframe.schema import SCANNER_ORD, as_findings
from argusframe.session import cut_lineage

def header(name: str, headers: str = "headers") -> Column:
    """Value of a header, repeated ones joined; null when absent. Names are
    lower-cased by the reader."""
    return F.array_join(F.element_at(headers, name), ", ")


def has_header(name: str, headers: str = "headers") -> Column:
    return F.coalesce(F.map_contains_key(headers, name), F.lit(False))


@dataclass(frozen=True)
class HeaderRule:
    """``hit`` decides on the headers; it is a column, so it stays in Catalyst."""
    id: str
    severity: str
    header: str
    hit: Callable[[], Column]
    title: str
    description: str
    recommendation: str


def _absent(name: str) -> Callable[[], Column]:
    return lambda: ~has_header(name)


def _present(name: str) -> Callable[[], Column]:
    return lambda: F.coalesce(header(name), F.lit("")) != ""


def _unframed() -> Column:
    policy = F.coalesce(header("content-security-policy"), F.lit(""))
    return ~(has_header("x-frame-options") | F.contains(policy, F.lit("frame-ancestors")))


HEADER_RULES = (
    HeaderRule("missing-hsts", "high", "strict-transport-security", _absent("strict-transport-security"),
               "No strict transport header", "Browsers may fall back to plain HTTP.", "Send Strict-Transport-Security with a long max-age."),
    HeaderRule("missing-csp", "medium", "content-security-policy", _absent("content-security-policy"),
               "No content security policy", "Nothing limits where scripts come from.", "Send a Content-Security-Policy."),
    HeaderRule("missing-nosniff", "medium", "x-content-type-options", _absent("x-content-type-options"),
               "No type sniffing guard", "Browsers may guess content types.", "Send X-Content-Type-Options: nosniff."),
    HeaderRule("missing-frame-guard", "medium", "x-frame-options", _unframed,
               "No framing guard", "Any site may frame the page.", "Send X-Frame-Options or a frame-ancestors policy."),
    HeaderRule("missing-referrer-policy", "low", "referrer-policy", _absent("referrer-policy"),
               "No referrer policy", "Full addresses leak to other sites.", "Send a Referrer-Policy."),
    HeaderRule("missing-permissions-policy", "low", "permissions-policy", _absent("permissions-policy"),
               "No permissions policy", "Browser features are not limited.", "Send a Permissions-Policy."),
)

LEAK_RULES = (
    HeaderRule("leaky-server", "low", "server", lambda: F.coalesce(header("server"), F.lit("")).rlike("[0-9]"),
               "Server version shown", "The Server header names a version.", "Shorten the Server header."),
    HeaderRule("leaky-powered-by", "low", "x-powered-by", _present("x-powered-by"),
               "Framework shown", "X-Powered-By names the framework.", "Drop the X-Powered-By header."),
    HeaderRule("leaky-aspnet", "low", "x-aspnet-version", _present("x-aspnet-version"),
               "Runtime version shown", "X-AspNet-Version names a version.", "Switch the header off."),
)

# Words that mark a session cookie; words of sensitive paths.
SESSION_WORDS = ("session", "sess", "sid", "token", "auth", "jwt", "access", "refresh", "csrf", "xsrf")
SENSITIVE_PATH_WORDS = ("/admin", "/api", "/internal", "/secret", "/private", "/dashboard", "/panel", "/staging", "/backup", "/db", "/config", "/debug")

_MIXED = r"""(?i)(?:src|href|action)=["']http://[^"']+["']"""
_HARMLESS = ("http://schemas.", "http://www.w3.org/")


@dataclass(frozen=True)
class Probe:
    """A path asked for. With ``body`` that test alone decides; without, the
    generic test does."""
    id: str
    path: str
    severity: str
    title: str
    body: Callable[[Column], Column] | None = None

    @property
    def category(self) -> str:
        return "secret" if self.severity == "critical" else "config"


def _any_of(*words: str) -> Callable[[Column], Column]:
    def test(body: Column) -> Column:
        hit = F.contains(body, F.lit(words[0]))
        for word in words[1:]:
            hit = hit | F.contains(body, F.lit(word))
        return hit
    return test


# Probed paths, severities and body marks.
PROBES = (
    Probe("probe-env", "/.env", "critical", "Environment file served"),
    Probe("probe-git-config", "/.git/config", "critical", "Repository folder served"),
    Probe("probe-git-head", "/.git/HEAD", "critical", "Repository folder served"),
    Probe("probe-env-local", "/.env.local", "critical", "Local environment file served"),
    Probe("probe-env-production", "/.env.production", "critical", "Production environment file served"),
    Probe("probe-wp-admin", "/wp-admin/", "medium", "WordPress login served", _any_of("wp-login", "WordPress", "wp-admin")),
    Probe("probe-phpinfo", "/phpinfo.php", "high", "PHP information page served", _any_of("phpinfo", "PHP Version")),
    Probe("probe-server-status", "/server-status", "medium", "Apache status page served", _any_of("Apache Server Status", "Server uptime")),
    Probe("probe-debug", "/debug", "medium", "Debug page served",
          lambda body: F.contains(body, F.lit("debug")) & ~F.contains(body, F.lit("<!doctype"))),
    Probe("probe-ds-store", "/.DS_Store", "low", "Folder listing file served"),
    Probe("probe-api-docs", "/api/docs", "low", "API documentation served"),
    Probe("probe-swagger", "/swagger.json", "low", "API description served"),
    Probe("probe-graphql", "/graphql", "low", "GraphQL endpoint served", _any_of('"data"', '"errors"', "GraphQL")),
)
MIN_PROBE_BODY = 10
BASELINE_BAND = 100

# Order of the checks in a web result.
_ORD = {rule_id: i for i, rule_id in enumerate(
    [r.id for r in HEADER_RULES + LEAK_RULES]
    + ["cookie-no-secure", "cookie-no-httponly", "cookie-no-samesite", "cors-wildcard-credentials", "cors-wildcard-origin",
       "mixed-content", "no-https-redirect"]
    + [p.id for p in PROBES] + ["robots-sensitive-paths", "missing-security-txt"], 1)}
# The three cookie checks are reported cookie by cookie.
_ORD.update({"cookie-no-httponly": _ORD["cookie-no-secure"], "cookie-no-samesite": _ORD["cookie-no-secure"]})


def _hit(test: Column, rule_id: str, severity: str, title: Column | str, description: Column | str,
         recommendation: Column | str, category: str = "config", file: str | None = None, seq: Column | int = 0) -> Column:
    """A finding struct where ``test`` holds, else null."""
    text = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.when(test, F.struct(
        F.lit(severity).alias("severity"), F.lit(category).alias("category"),
        text(title).alias("title"), text(description).alias("description"),
        F.lit(file).cast("string").alias("file"), text(recommendation).alias("recommendation"),
        F.lit(rule_id).alias("rule_id"), F.lit(_ORD[rule_id]).alias("rule_ord"),
        (F.lit(seq) if isinstance(seq, int) else seq).cast("int").alias("seq")))


def _collect(rows: DataFrame, hits: list[Column]) -> DataFrame:
    return as_findings(
        rows.select("target_id", F.explode(F.array(*hits)).alias("hit")).filter(F.col("hit").isNotNull())
        .select("target_id", F.lit("web").alias("scanner"), "hit.*", F.lit(SCANNER_ORD["web"]).alias("scanner_ord")))


def _of_kind(responses: DataFrame, kind: str) -> DataFrame:
    """Exchanges of a kind that got an answer."""
    return responses.filter((F.col("kind") == kind) & F.col("status").isNotNull())


def _header_hits() -> list[Column]:
    missing = [_hit(r.hit(), r.id, r.severity, r.title, r.description, r.recommendation) for r in HEADER_RULES]
    leaks = [
        _hit(r.hit(), r.id, r.severity, r.title,
             message(r.description + " Value: \"{value}\"", value=header(r.header)), r.recommendation)
        for r in LEAK_RULES
    ]
    return missing + leaks


def check_headers(responses: DataFrame) -> DataFrame:
    return _collect(_of_kind(responses, "main"), _header_hits())


def cookie_name(cookie: Column) -> Column:
    return first_present(trim_space(F.get(F.split(cookie, "="), F.lit(0))), "unknown")


def explode_cookies(responses: DataFrame) -> DataFrame:
    """``(target_id, seq, cookie, name)`` of each cookie set by the main page."""
    return (
        _of_kind(responses, "main")
        .select("target_id", F.posexplode(F.element_at("headers", "set-cookie")).alias("seq", "cookie"))
        .withColumn("name", cookie_name(F.col("cookie")))
    )


def is_session_cookie(name: Column) -> Column:
    return F.lower(name).rlike("|".join(SESSION_WORDS))


def _cookie_hits(cookie: Column, pos: Column) -> list[Column]:
    low, name, place = F.lower(cookie), cookie_name(cookie), pos * 3
    lacks = lambda word: ~F.contains(low, F.lit(word))
    return [
        _hit(lacks("secure"), "cookie-no-secure", "medium", message('Cookie "{name}" without Secure', name=name),
             "The cookie may travel over plain HTTP.", "Set the Secure attribute.", seq=place),
        _hit(lacks("httponly") & is_session_cookie(name), "cookie-no-httponly", "medium",
             message('Session cookie "{name}" without HttpOnly', name=name),
             "Scripts can read the session cookie.", "Set the HttpOnly attribute.", seq=place + 1),
        _hit(lacks("samesite"), "cookie-no-samesite", "low", message('Cookie "{name}" without SameSite', name=name),
             "The cookie may be sent with requests of other sites.", "Set the SameSite attribute.", seq=place + 2),
    ]


def check_cookies(responses: DataFrame) -> DataFrame:
    return _collect(explode_cookies(responses), _cookie_hits(F.col("cookie"), F.col("seq")))


def _cors_hits() -> list[Column]:
    open_ = F.coalesce(header("access-control-allow-origin") == "*", F.lit(False))
    trusted = F.coalesce(header("access-control-allow-credentials") == "true", F.lit(False))
    return [
        _hit(open_ & trusted, "cors-wildcard-credentials", "critical", "Every origin allowed with credentials",
             "Any site can act as the user and read the answers.", "Name exact origins where credentials are on."),
        _hit(open_ & ~trusted, "cors-wildcard-origin", "low", "Every origin allowed",
             "Any site can read the answers.", "Name the origins that may read."),
    ]


def check_cors(responses: DataFrame) -> DataFrame:
    return _collect(_of_kind(responses, "main"), _cors_hits())


def mixed_resources(body: Column) -> Column:
    """Plain-HTTP addresses in source, link or action attributes."""
    found = F.regexp_extract_all(body, F.lit(_MIXED), F.lit(0))
    return F.filter(found, lambda a: ~(F.contains(a, F.lit(_HARMLESS[0])) | F.contains(a, F.lit(_HARMLESS[1]))))


def _mixed_hits() -> list[Column]:
    resources = mixed_resources(F.col("body"))
    hit = F.startswith("url", F.lit("https://")) & (F.size(resources) > 0)
    return [_hit(
        hit, "mixed-content", "medium",
        message("Mixed content: {n} plain HTTP addresses", n=F.size(resources)),
        message("The page loads over plain HTTP: {first}", first=F.array_join(F.slice(resources, 1, 3), ", ")),
        "Load everything over HTTPS.")]


def check_mixed_content(responses: DataFrame) -> DataFrame:
    return _collect(_of_kind(responses, "main"), _mixed_hits())


def _redirect_hits() -> list[Column]:
    location = F.coalesce(header("location"), F.lit(""))
    test = F.startswith("url", F.lit("https://")) & ~F.startswith(location, F.lit("https://"))
    return [_hit(test, "no-https-redirect", "high", "Plain HTTP is not redirected",
                 "Visitors who leave out the scheme stay on plain HTTP.", "Redirect all plain HTTP requests to HTTPS.")]


def check_https_redirect(responses: DataFrame) -> DataFrame:
    """HTTPS targets whose plain-HTTP answer does not lead to HTTPS."""
    return _collect(_of_kind(responses, "http_head"), _redirect_hits())


def soft404_baseline(responses: DataFrame) -> DataFrame:
    """Body length of the missing page per target, whatever its status."""
    return (
        _of_kind(responses, "missing_page")
        .groupBy("target_id").agg(F.max(utf16_length(F.coalesce("body", F.lit("")))).alias("baseline"))
    )


def _body() -> Column:
    return F.coalesce("body", F.lit(""))


def _probe_hit(probe: Probe, test: Column) -> Column:
    return _hit((F.col("path") == probe.path) & test, probe.id, probe.severity, probe.title,
                message("{path} can be read by anyone.", path=F.col("path")),
                message("Take {path} off the server or restrict it.", path=F.col("path")),
                probe.category, probe.path)


def _is_file_body() -> Column:
    """Body that is neither tiny nor a page."""
    start = trim_start(_body())
    page = F.startswith(start, F.lit("<!")) | F.startswith(start, F.lit("<html"))
    return (utf16_length(_body()) >= MIN_PROBE_BODY) & ~page


def _unlike_baseline(length: Column) -> Column:
    base = F.coalesce("baseline", F.lit(0))
    return ~((base > 0) & (F.abs(length - base) < BASELINE_BAND))


def check_probes(responses: DataFrame, probes: tuple[Probe, ...] = PROBES) -> DataFrame:
    rows = _of_kind(responses, "probe").filter((F.col("status") == 200) & F.col("path").isin(*[p.path for p in probes]))
    marked, generic = [p for p in probes if p.body], [p for p in probes if not p.body]
    by_body = _collect(rows, [_probe_hit(p, p.body(_body())) for p in marked]) if marked else None
    if not generic:
        return by_body
    # Reduce the rows to lengths before the baseline is joined.
    files = rows.filter(F.col("path").isin(*[p.path for p in generic]) & _is_file_body()).select(
        "target_id", "path", utf16_length(_body()).alias("length"))
    files = salted_join(files, soft404_baseline(responses), ["target_id"], "left").filter(_unlike_baseline(F.col("length")))
    by_file = _collect(files, [_probe_hit(p, F.lit(True)) for p in generic])
    return by_file if by_body is None else by_body.unionByName(by_file)


def sensitive_robots_paths(body: Column) -> Column:
    lines = F.transform(F.split(body, "\n"), trim_space)
    rules = F.filter(lines, lambda l: F.startswith(F.lower(l), F.lit("disallow:")))
    paths = F.transform(rules, lambda l: trim_space(F.regexp_replace(l, "^[^:]*:", "")))
    words = "|".join(SENSITIVE_PATH_WORDS)
    return F.filter(paths, lambda p: (p != "") & F.lower(p).rlike(words))


def _robots_hits() -> list[Column]:
    readable = (F.col("status") == 200) & (_body() != "") & ~F.contains(_body(), F.lit("<!DOCTYPE"))
    paths = sensitive_robots_paths(F.col("body"))
    return [_hit(
        readable & (F.size(paths) > 0), "robots-sensitive-paths", "low", "robots.txt names sensitive paths",
        message("The file points at: {first}", first=F.array_join(F.slice(paths, 1, 5), ", ")),
        "Protect these paths by login.")]


def check_robots(responses: DataFrame) -> DataFrame:
    return _collect(_of_kind(responses, "robots"), _robots_hits())


def _security_txt_finding(flags: DataFrame) -> DataFrame:
    return _collect(flags.filter("reached"), [_hit(
        ~F.col("served"), "missing-security-txt", "low", "No security.txt",
        "Finders of flaws do not learn whom to tell.", "Serve /.well-known/security.txt.")])


def check_security_txt(responses: DataFrame) -> DataFrame:
    """Reachable targets without a served security.txt, as one aggregation."""
    ok = F.col("status").isNotNull()
    return _security_txt_finding(
        responses.filter(F.col("kind").isin("main", "security_txt"))
        .groupBy("target_id")
        .agg(F.max((F.col("kind") == "main") & ok).alias("reached"),
             F.max((F.col("kind") == "security_txt") & F.coalesce(F.col("status") == 200, F.lit(False))).alias("served")))


def reachable_targets(responses: DataFrame) -> DataFrame:
    return _of_kind(responses, "main").select("target_id").distinct()


def web_errors(responses: DataFrame) -> DataFrame:
    """``(target_id, scanner, error)`` of targets whose main page gave no answer."""
    return (
        responses.groupBy("target_id")
        .agg(F.max((F.col("kind") == "main") & F.col("status").isNotNull()).alias("reached"))
        .filter(~F.col("reached"))
        .select("target_id", F.lit("web").alias("scanner"), F.lit("main page not reached").alias("error"))
    )


def web_evidence(responses: DataFrame) -> DataFrame:
    """``(target_id, note, length, hit)``: everything the web scan needs from
    the exchanges, taken in one pass over headers and bodies. ``note`` is
    ``hit`` (a finding), ``candidate`` (a finding unless its body is as long as
    the baseline), ``baseline``, ``reached`` or ``served``."""
    kind, ok = F.col("kind"), F.col("status").isNotNull()
    served = F.coalesce(F.col("status") == 200, F.lit(False))
    at = lambda k, hits: [F.when((kind == k) & ok, h) for h in hits]
    marked, generic = [p for p in PROBES if p.body], [p for p in PROBES if not p.body]
    hits = (
        at("main", _header_hits() + _cors_hits() + _mixed_hits()) + at("http_head", _redirect_hits())
        + at("probe", [_probe_hit(p, served & p.body(_body())) for p in marked]) + at("robots", _robots_hits())
    )
    candidate = F.coalesce(*at("probe", [_probe_hit(p, served & _is_file_body()) for p in generic]))
    cookies = F.when((kind == "main") & ok, F.element_at("headers", "set-cookie"))
    cookie_hits = F.flatten(F.transform(cookies, lambda c, i: F.array(*_cookie_hits(c, i))))
    length = utf16_length(_body()).cast("int")

    def item(note: str, test: Column, value: Column | None = None, hit: Column | None = None) -> Column:
        nothing = F.when(F.lit(False), candidate)
        return F.when(test, F.struct(
            F.lit(note).alias("note"), (value if value is not None else F.lit(None)).cast("int").alias("length"),
            (hit if hit is not None else nothing).alias("hit")))

    found = F.concat(F.array(*hits), F.coalesce(cookie_hits, F.array().cast(_HITS)))
    items = F.concat(
        F.transform(found, lambda h: item("hit", h.isNotNull(), hit=h)),
        F.array(
            item("candidate", candidate.isNotNull(), length, candidate),
            item("baseline", (kind == "missing_page") & ok, length),
            item("reached", (kind == "main") & ok),
            item("served", (kind == "security_txt") & served)))
    return (
        responses.select("target_id", F.explode(items).alias("item")).filter(F.col("item").isNotNull())
        .select("target_id", "item.*")
    )


_HITS = ("array<struct<severity:string,category:string,title:string,description:string,file:string,"
         "recommendation:string,rule_id:string,rule_ord:int,seq:int>>")


def scan_web(responses: DataFrame) -> DataFrame:
    """All web findings, from one pass over the exchanges. Targets that were
    not reached have none."""
    evidence = cut_lineage(web_evidence(responses))
    of = lambda note: evidence.filter(F.col("note") == note)
    baseline = of("baseline").groupBy("target_id").agg(F.max("length").alias("baseline"))
    candidates = salted_join(of("candidate"), baseline, ["target_id"], "left").filter(_unlike_baseline(F.col("length")))
    hits = of("hit").select("target_id", "hit").unionByName(candidates.select("target_id", "hit"))
    hits = salted_join(hits, of("reached").select("target_id").distinct(), ["target_id"], "left_semi")
    flags = of("reached").unionByName(of("served")).groupBy("target_id").agg(
        F.max(F.col("note") == "reached").alias("reached"), F.max(F.col("note") == "served").alias("served"))
    found = as_findings(hits.select(
        "target_id", F.lit("web").alias("scanner"), "hit.*", F.lit(SCANNER_ORD["web"]).alias("scanner_ord")))
    return found.unionByName(_security_txt_finding(flags))
