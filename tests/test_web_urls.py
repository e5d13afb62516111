from __future__ import annotations

from conftest import rows
from pyspark.sql import functions as F

from argusframe.functions import text, urls
from argusframe.operators import web
from argusframe.sources.tables import lower_header_names


def test_headers(make_responses):
    everything = {"strict-transport-security": ["a"], "content-security-policy": ["frame-ancestors none"], "x-content-type-options": ["nosniff"],
                  "referrer-policy": ["a"], "permissions-policy": ["a"], "server": ["nginx"]}
    r = make_responses([("a", "main", "/", 200, everything, ""), ("b", "main", "/", 500, {"server": ["nginx/1.2"], "x-powered-by": [""]}, ""),
                        ("c", "main", "/", None, None, None)])
    assert rows(web.check_headers(r), "target_id", "rule_id") == [("b", i) for i in sorted((
        "leaky-server", "missing-csp", "missing-frame-guard", "missing-hsts", "missing-nosniff", "missing-permissions-policy", "missing-referrer-policy"))]
    assert rows(web.web_errors(r), "target_id") == [("c",)]


def test_header_names_in_any_case(make_responses):
    r = lower_header_names(make_responses([("a", "main", "/", 200, {"Set-Cookie": ["a=1"], "set-cookie": ["b=2"], "Server": ["x"]}, "")]))
    assert {k: sorted(v) for k, v in r.first().headers.items()} == {"set-cookie": ["a=1", "b=2"], "server": ["x"]}


def test_cookies_and_cors(make_responses):
    star = {"access-control-allow-origin": ["*"]}
    r = make_responses([("a", "main", "/", 200, {"set-cookie": ["sid=1", "__Secure-a=1", "=x"]} | star, ""),
                        ("b", "main", "/", 200, star | {"access-control-allow-credentials": ["true"]}, ""),
                        ("c", "main", "/", 200, {"access-control-allow-origin": ["https://x"]}, "")])
    assert rows(web.check_cookies(r), "seq", "rule_id", "title") == sorted([
        (0, "cookie-no-secure", 'Cookie "sid" without Secure'), (1, "cookie-no-httponly", 'Session cookie "sid" without HttpOnly'),
        (2, "cookie-no-samesite", 'Cookie "sid" without SameSite'), (5, "cookie-no-samesite", 'Cookie "__Secure-a" without SameSite'),
        (6, "cookie-no-secure", 'Cookie "unknown" without Secure'), (8, "cookie-no-samesite", 'Cookie "unknown" without SameSite')], key=repr)
    assert rows(web.check_cors(r), "target_id", "severity") == [("a", "low"), ("b", "critical")]


def test_mixed_content(make_responses):
    body = '<a HREF="http://b/"></a><script src=\'http://c/\'></script><svg href="http://www.w3.org/2000/svg"/><i src="http://schemas.x/"/>'
    assert rows(web.check_mixed_content(make_responses([("a", "main", "/", 200, None, body)])), "title") == [("Mixed content: 2 plain HTTP addresses",)]


def test_probes(make_responses):
    probe = lambda t, body, path="/.env", status=200: (t, "probe", path, status, None, body)
    base = lambda t, n: (t, "missing_page", "/x", 404, None, "n" * n)
    r = make_responses([
        probe("short", "123456789"), probe("page", " \n<!doctype html> long"), probe("near", "y" * 199), base("near", 100), probe("far", "y" * 200), base("far", 100),
        probe("none", "y" * 20), probe("gone", "y" * 20, status=404), probe("emoji", "😀" * 5), probe("dbg", "debug", "/debug"),
        probe("dbg2", "debug <!doctype", "/debug"), probe("dbg3", "debug <!DOCTYPE", "/debug")])
    assert rows(web.check_probes(r), "target_id", "category") == [(t, c) for t, c in (
        ("dbg", "config"), ("dbg3", "config"), ("emoji", "secret"), ("far", "secret"), ("none", "secret"))]


def test_robots_security_redirect_and_whole_scan(make_responses):
    r = make_responses([
        ("a", "main", "/", 200, None, ""), ("a", "robots", "/robots.txt", 200, None, "DISALLOW: /Admin\nDisallow:\n disallow:/x:/api "),
        ("a", "http_head", "/", 301, {"location": ["http://x"]}, None), ("b", "main", "/", 200, None, ""), ("b", "security_txt", "/s", 200, None, "c"),
        ("b", "robots", "/robots.txt", 200, None, "<!DOCTYPE\nDisallow: /admin"), ("c", "main", "/", None, None, None),
        ("c", "http_head", "/", 200, None, None), ("c", "robots", "/robots.txt", 200, None, "Disallow: /db")])
    assert rows(web.check_robots(r), "target_id", "description") == [("a", "The file points at: /Admin, /x:/api"), ("c", "The file points at: /db")]
    assert rows(web.check_security_txt(r), "target_id") == [("a",)]
    assert rows(web.check_https_redirect(r), "target_id") == [("a",), ("c",)]
    apart = web.check_headers(r)
    for part in (web.check_cookies(r), web.check_cors(r), web.check_mixed_content(r), web.check_https_redirect(r), web.check_probes(r),
                 web.check_robots(r), web.check_security_txt(r)):
        apart = apart.unionByName(part)
    assert rows(web.scan_web(r), "*") == rows(apart.filter("target_id <> 'c'"), "*")


def test_addresses(spark):
    check = lambda values, column: [r[0] for r in spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, v string").orderBy("n").select(column).collect()]
    v = F.col("v")
    assert check(["app.js", "example.com", "HTTP://x", "./dir"], urls.classify_target(v)) == ["web", "web", "web", "code"]
    assert check([" a.b// ", "HTTP://x", "http://y/"], urls.normalize_url(v)) == ["https://a.b", "https://HTTP://x", "http://y"]
    hosts = ["172.99.0.1", "169.254.1.1", "a.local", "LOCALHOST", "https://u:p@10.1.1.1:80/x", "httpx.com", "", "https://a:99999/"]
    assert check(hosts, urls.admit_url(v)["reason"]) == [
        "private address", None, "private address", "private address", "private address", "invalid url", "invalid url", "invalid url"]
    repos = ["github.com/a/b.git", "gitlab.com/a/b", "github.com/a", "https://www.github.com/o+x/r.s/tree"]
    assert [(r.owner, r.repo, r.reason) for r in check(repos, urls.canonical_repo(v))] == [
        ("a", "b", None), (None, None, "unsupported host"), (None, None, "owner and repository required"), ("ox", "r.s", None)]
    assert check(["a.js", ".env", "x/.a.JS", "a.", "b/c"], text.path_extension(v)) == [".js", "", ".js", ".", ""]
    assert check(["\ufeff\u00a0 a \u2028"], text.trim_space(v)) == ["a"]
    assert check(["a<&>\"'"], text.escape_html(v)) == ["a&lt;&amp;&gt;&quot;&#039;"]
    assert check(["a"], text.decode_utf8(F.lit(b"a\xffb"))) == ["a\ufffdb"]


def test_hosts_in_other_spellings(spark):
    private = ["127.1", "2130706433", "0x7f.0.0.1", "0x7f000001", "0177.0.0.1", "http://%6c%6fcalhost/", "http://10.1", "http://3232235777", "127.0.0.1.", "http://0x7F.1/"]
    invalid = ["http://256.1.1.1.1", "http://1.2.3.4.5", "http://999", "http://1.256.1.1", "http://09.1", "http://4294967296", "http://%2f.com", "http://a%zz.com"]
    fine = ["example.com", "8.8.8.8", "134744072", "http://1e100.net", "http://0x7f.example.com"]
    df = spark.createDataFrame([(t,) for t in private + invalid + fine], "t string")
    got = {r.t: r.reason for r in df.select("t", urls.admit_url(F.col("t"))["reason"].alias("reason")).collect()}
    assert {t: got[t] for t in private} == dict.fromkeys(private, "private address")
    assert {t: got[t] for t in invalid if t != "http://999"} == {t: "invalid url" for t in invalid if t != "http://999"}
    assert {t: got[t] for t in fine} == dict.fromkeys(fine)


def test_address_steps_are_planned_once(spark):
    """The plan of a request grows with the steps, not with the branches that ask for their results."""
    from argusframe.streaming.scan_stream import stream_admission
    requests = spark.createDataFrame([(1, "website", "http://127.1/", 5), (2, "repo", "github.com/a/b.git", 5), (3, "repo", "github.com/a", 5)],
                                     "request_id long, kind string, target string, size long")
    admitted = stream_admission(requests)
    assert rows(admitted, "request_id", "reason") == [(1, "private address"), (2, None), (3, "owner and repository required")]
    plan = admitted.select("reason")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") <= 10
