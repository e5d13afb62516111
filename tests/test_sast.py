from __future__ import annotations

import re

import pytest
from conftest import rows
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from argusframe.functions.regex import java_pattern
from argusframe.operators.rules import AI_RULES, FILE, LINE, RULES, RULES_BY_ID, Rule, check_rules, number_user_rules, prune_rules
from argusframe.operators.sast import env_not_ignored, first_match_per_file, line_matches, match_rule_table, rule_hits, scan_sources
from argusframe.sources.rule_catalog import parse_user_rules, register_rules, rules_table
from crosscheck.snippets import SNIPPETS

# One hit and one near miss per rule; a file type the rule knows.
CASES = {
    "sql-injection": ("db.query('a' + b)", "db.query('a', b)"),
    "nosql-injection": ("u.find({ a: req.body.a })", "u.find({ a: b })"),
    "xss-dangerouslysetinnerhtml": ("<p dangerouslySetInnerHTML={{ __html: x }}/>", "<p dangerouslySetInnerHTML={x}/>"),
    "eval-usage": ("x = eval (y)", "x = medieval(y)"),
    "cors-wildcard": ("origin: '*'", "'origin': '*'"),
    "cors-credentials-wildcard": ("credentials: true", "credentials: false"),
    "hardcoded-password": ("passwd = 'abcd'", "passwd = 'abc'"),
    "no-password-hash": ("password: req.body.password }).save()", "password: req.body.password"),
    "weak-jwt-secret": ("jwt.sign(a, 'short')", "jwt.sign(a, 'sixteen-or-longer')"),
    "missing-security-headers": ("a = express()", "a = express(); helmet()"),
    "exposed-debug-route": ("r.get('/_debug/x')", "r.get('/x/_debug')"),
    "open-redirect": ("redirect(req.query.a)", "redirect(a)"),
    "unvalidated-upload": ("Upload", "upload with mimetype"),
    "insecure-cookie": ("cookie({})", "cookie({ Secure: true })"),
    "command-injection": ("spawn(`a ${b}`)", "spawn('a') + req.b"),
    "ssl-verification-disabled": ("rejectUnauthorized: false", "rejectUnauthorized: true"),
    "sensitive-url-params": ("'?auth=' + a", "'?author=' + a"),
    "no-rate-limiting": ("app.post('/api/x')", "app.post('/api/x') // throttle"),
    "python-os-system": ("os.system('a')", "os.systems('a')"),
    "python-pickle": ("pickle.loads(a)", "pickle.dumps(a)"),
    "path-traversal": ("readFile(req.a)", "readFile(a)"),
    "path-traversal-express": ("res.sendFile(query.a)", "res.sendFile(a)"),
    "ssrf-fetch": ("fetch(req.query.u)", "axios(req.query.u)"),
    "weak-crypto-md5": ("createHash('md5')", "hashlib.md5(x)"),
    "weak-crypto-sha1": ("crypto.createHash('sha1')", "crypto.createHash('sha256')"),
    "weak-crypto-des": ("createCipheriv('rc4', k)", "createCipheriv('des3', k)"),
    "insecure-random": ("Math.random()", "Math.random(1)"),
    "prototype-pollution": ("_.merge(a, req.body)", "_.merge(a, b)"),
    "prototype-pollution-bracket": ("a[req.k] == 1", "a[k] = 1"),
    "loose-equality": ("if (req.a == b)", "if (req.a === b)"),
    "xss-innerhtml": ('x.innerHTML = "<br>"', 'x.innerHTML="<br>"'),
    "xss-document-write": ("document.write(a)", "document.writeln(a)"),
    "yaml-unsafe-load": ("yaml.load(a)", "yaml.load(a, SafeLoader)"),
    "js-yaml-unsafe": ("yaml.load(a, { schema: yaml.DEFAULT_SCHEMA })", "yaml.load(a)"),
    "sensitive-data-logged": ("logger.warn(token)", "log.warn(token)"),
    "no-csrf-protection": ("app.delete(a)", "app.delete(a) // xsrf"),
    "jwt-none-algorithm": ("algorithm: ['none']", "algorithm: 'none'"),
    "unhandled-async": ("r.get('/a', async (q) => b)", "r.get('/a', async (q) => b.catch(c))"),
    "redos-risk": ("new RegExp(req.a)", "new RegExp(a)"),
    "unsafe-json-parse": ("JSON.parse(body)", "JSON.parse(text)"),
    "python-subprocess-shell": ("subprocess.call(a, shell=True)", "subprocess.call(a)"),
    "python-format-injection": ("a.format(kwargs)", "a.format(b)"),
    "hardcoded-localhost": ("'http://127.0.0.1:80'", "'http://127.0.0.11'"),
    "missing-auth-middleware": ("r.get('/users/1', a)", "r.get('/users/1', requireAuth, a)"),
    "ai/hardcoded-api-key-in-source": ("key = 'sk-abc'", "key = 'ask-abc'"),
    "ai/cors-allow-all-origins": ("cors({ origin: true })", "cors({ origin: list })"),
    "ai/raw-sql-concatenation": ("db.execute(`a ${b}`)", "db.execute('a')"),
    "ai/express-no-helmet": ("const a = express()", "const a = express(); a.use(helmet())"),
    "ai/password-without-hashing": ("{ password: q.body.password }", "{ password: q.body.pw }"),
    "ai/jwt-weak-secret": ("jwt.sign(p, 'long literal secret')", "jwt.sign(p, key)"),
    "ai/unvalidated-redirect": ("res.redirect(q.query.url)", "res.redirect(url)"),
    "ai/exposed-admin-route": ("r.get('/admin/x')", "r.get('/admin')"),
}


def test_every_rule_hits_misses_and_knows_its_types(make_files):
    rules = [r for r in RULES + AI_RULES if r.scope in (LINE, FILE)]
    assert {r.id for r in rules} == set(CASES)
    data = []
    for n, rule in enumerate(rules):
        hit, miss = CASES[rule.id]
        ext = rule.extensions[0]
        data += [(f"hit{n}", f"a{ext}", hit), (f"miss{n}", f"a{ext}", miss), (f"type{n}", "a.txt", hit)]
        if rule.scope == LINE:
            data.append((f"note{n}", f"a{ext}", f"  // {hit}\n\t* {hit}\n/* {hit}\n pattern : {hit}"))
    found = {(r.target_id, r.rule_id) for r in scan_sources(make_files(data), rules).collect()}
    for n, rule in enumerate(rules):
        assert (f"hit{n}", rule.id) in found, rule.id
        for kind in ("miss", "type", "note"):
            assert (f"{kind}{n}", rule.id) not in found, (kind, rule.id)


def test_first_line_hash_comments_and_endings(make_files):
    f = make_files([("t", "a.js", "x\n\neval(1)\r\nno\neval(2)"), ("t", "b.py", "# os.system(1)"), ("t", "c.js", "const s='😀😀'\n// 😀\n😀 eval(s)\n"),
                    ("t", "d.js", "a ==\nreq.b")])
    assert rows(scan_sources(f), "file", "rule_id", "line") == [("a.js", "eval-usage", 3), ("b.py", "python-os-system", 1), ("c.js", "eval-usage", 3)]


def test_size_depth_and_names(make_files):
    deep = "/".join("abcdefghi") + "/x.js"
    f = make_files([("t", "big.js", "eval(1)", 1048577), ("t", "edge.js", "eval(1)", 1048576), ("t", deep, "eval(1)"), ("t", "z/" + deep, "eval(1)"),
                    ("t", "node_modules/a.js", "eval(1)"), ("t", ".x/a.js", "eval(1)"), ("t", "spec/a.js", "eval(1)"), ("t", "A.JS", "eval(1)")])
    assert rows(scan_sources(f), "file") == [("A.JS",), (deep,), ("edge.js",)]


def test_env(make_files):
    f = make_files([("a", ".env", ""), ("b", ".env", ""), ("b", ".gitignore", "dist"), ("c", ".env", ""), ("c", ".gitignore", ".env*"),
                    ("d", ".gitignore", ""), ("e", "sub/.env", "")])
    assert rows(env_not_ignored(f), "target_id", "file", "category", "severity") == [("a", ".env", "config", "high"), ("b", ".gitignore", "config", "high")]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(SNIPPETS + ["", "  ", "plain text", "// note"]), max_size=6), min_size=1, max_size=40))
def test_text_search_equals_line_by_line(spark, make_files, texts):
    """The search in whole texts, with and without the needle test, finds what
    matching exploded lines finds."""
    data = [(f"t{n % 3}", f"f{n}{ext}", "\n".join(parts).replace("¶", "\n").replace("¤", "\r").replace("§", "$"))
            for n, parts in enumerate(texts) for ext in (".js", ".py")]
    f = make_files(data).repartition(3)
    rules = [r for r in RULES + AI_RULES if r.scope == LINE]
    ords = {r.ord: r.id for r in rules}
    fast, plain = rule_hits(f, rules), rule_hits(f, rules, use_needles=False)
    as_set = lambda df: {(r.target_id, r.path, ords[r.rule_ord], r.line) for r in df.collect()}
    lines = {(r.target_id, r.path, r.rule_id, r.line) for r in first_match_per_file(line_matches(f, rules)).collect()}
    assert as_set(fast) == as_set(plain) == lines


def test_severity_prune_equals_filter(make_files):
    f = make_files([("t", "a.js", "eval(1)\nexec(`${x}`)\norigin: '*'")])
    pruned = rows(scan_sources(f, prune_rules(RULES, "high")), "rule_id")
    assert pruned == rows(scan_sources(f).filter(F.col("severity").isin("critical", "high")), "rule_id")
    with pytest.raises(ValueError):
        prune_rules(RULES, "info")


def test_user_rules(spark, make_files):
    f = make_files([("t", "a.rb", "x\nputs 1\nputs 2"), ("t", "b.rb", "safe puts")])
    rules = parse_user_rules('[{"id": "puts", "severity": "low", "extensions": [".rb"], "scope": "line", "pattern": "^puts", "title": "p"},'
                             ' {"id": "whole", "severity": "high", "extensions": [".rb"], "scope": "file", "pattern": "puts", "anti": "safe"}]')
    table = rules_table(spark, rules).select(F.col("rule_id").alias("id"), "severity", "extension", "scope", "pattern", "anti", "title",
                                             F.lit("").alias("description"), F.lit("").alias("recommendation"))
    joined = rows(match_rule_table(f, table), "file", "line", "rule_id")
    assert joined == [("a.rb", 2, "puts"), ("a.rb", None, "whole")]
    assert register_rules(table) is table and [r.id for r in register_rules(rules)] == ["puts", "whole"]
    assert rows(scan_sources(f, rules), "file", "line", "rule_id", "rule_ord", "description") == rows(match_rule_table(f, table), "file", "line", "rule_id", "rule_ord", "description")
    for bad in (Rule("x", "info", (), LINE, "a"), Rule("x", "low", (), "word", "a"), Rule("x", "low", (".a",), LINE, "(")):
        with pytest.raises(ValueError):
            check_rules([bad])
    with pytest.raises(ValueError):
        number_user_rules([Rule("x", "low", (), LINE, "a"), Rule("x", "low", (), LINE, "a")])


def test_scan_stage_has_no_shuffle_and_reads_needed_columns(spark, tmp_path, make_files):
    make_files([("t", "a.js", "eval(1)")]).write.parquet(str(tmp_path / "f"))
    plan = scan_sources(spark.read.parquet(str(tmp_path / "f")))._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange (hash|range|RoundRobin|Single)", plan)
    assert re.search(r"PushedFilters: \[[^\]]*LessThanOrEqual\(size_bytes,1048576\)", plan)


def test_env_rule_is_special():
    assert RULES_BY_ID["env-not-gitignored"].scope not in (LINE, FILE)


PIECES = ["^", "$", r"\W", r"\D", r"\b", r"\s", "a", "b", "1", r"[^a]", r"[\W1]", ".", "(?:a|b)", " "]


def test_user_line_rules_unrolled_equal_the_table(spark, make_files):
    """Generated patterns with anchors and negated classes: whole-text search, table and plain matching line by line agree."""
    import random
    rng = random.Random(9)
    patterns = ["".join(rng.choice(PIECES) for _ in range(rng.randint(2, 4))) + rng.choice(["a", "b", "1", "$", r"\W"]) for _ in range(90)]
    rules = number_user_rules([Rule(f"r{k}", "low", (".rb",), LINE, p) for k, p in enumerate(patterns) if not re.search(p.replace("$", r"\Z"), "")])
    with pytest.raises(ValueError):
        number_user_rules([Rule("empty", "low", (".rb",), LINE, "^a*$")])
    texts = ["".join(rng.choice(["a", "b", "1", " ", "\n", "\n", "-"]) for _ in range(rng.randint(1, 30))) for _ in range(40)]
    f = make_files([("t", f"f{k}.rb", t) for k, t in enumerate(texts)])
    table = rules_table(spark, rules).select(F.col("rule_id").alias("id"), "severity", "extension", "scope", "pattern", "anti", "title", F.lit("").alias("description"), F.lit("").alias("recommendation"))
    plain = []
    for k, text in enumerate(texts):
        for rule in rules:
            for n, line in enumerate(text.split("\n"), 1):
                if re.search(rule.pattern.replace("$", r"\Z"), line):
                    if line or not re.search(rule.pattern.replace("$", r"\Z"), ""):
                        plain.append((f"f{k}.rb", n, rule.id))
                        break
    assert rows(match_rule_table(f, table), "file", "line", "rule_id") == rows(scan_sources(f, rules), "file", "line", "rule_id")
    assert rows(scan_sources(f, rules), "file", "line", "rule_id") == sorted(plain, key=repr)


def test_patterns_take_linear_time_and_hit_the_same_lines(spark, make_files):
    """Lines that made the plain patterns quadratic, 256 KB each, within seconds; and equality with the plain patterns on generated lines."""
    import random
    import time
    hostile = ["a == 1;" + "req.a;" * 40_000, "stat(a;" * 36_000, "exec(" * 50_000, "console.log(a " * 18_000, "new RegExp(" * 23_000, "subprocess.run(" * 17_000, "-----BEGIN " + "AB " * 80_000]
    f = make_files([("t", f"f{k}{e}", text) for k, text in enumerate(hostile) for e in (".js", ".py")])
    started = time.time()
    scan_sources(f).count()
    assert time.time() - started < 60
    rng = random.Random(12)
    names = ["stat", "exec", "fetch", "sendFile", "Object.assign", "new RegExp", "console.log", "subprocess.run", "jwt.sign", "yaml.load"]
    scraps = [*names, "(", "(", ")", "req.", "body.", "${", "==", "===", "x", " ", " ", "'abc'", "{", "}", "schema: yaml.DEFAULT_SCHEMA", "shell = True", "password", ";", "=1"]
    lines = ["".join(rng.choice(scraps) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    f = make_files([("t", f"g{k}{e}", text) for k, text in enumerate(lines) for e in (".js", ".py")])
    got = {(r.file, r.rule_id) for r in scan_sources(f).collect()}
    checked = [r for r in RULES if r.java != java_pattern(r.pattern, r.ignore_case, single_line=True) and r.scope == LINE]
    assert len(checked) == 11
    for rule in checked:
        plain = re.compile(rule.pattern, re.I if rule.ignore_case else 0)
        expected = {(f"g{k}{e}", rule.id) for k, text in enumerate(lines) for e in (".js", ".py") if e in rule.extensions and plain.search(text)}
        skipped = {(f"g{k}{e}", rule.id) for k, text in enumerate(lines) for e in (".js", ".py") if text.lstrip().startswith(("*", "//", "/*"))}
        assert {x for x in got if x[1] == rule.id} - skipped == expected - skipped
