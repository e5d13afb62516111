from __future__ import annotations

import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from argusframe.plans.scan import Engine, ScanOptions
from argusframe.operators.syntax import BLANK, CLOSE, OPEN, scan_syntax, syntax_hits, token_text

# For each rule: texts that it finds, on one line, and texts that it must not find.
CASES = {
    "ai/hardcoded-api-key-in-source": (["const key = 'sk-abc'", 'config.token = "ghp_1234"', "KEY = \"sk_live_x\"", "a.b.c = 'AKIA1'"], ["key == 'sk-abc'", "key = 'xsk-abc'", "key = sk-abc"]),
    "ai/cors-allow-all-origins": (["app.use(cors({ origin: '*' }))", "cors({ credentials: f(1, [2]), origin: true })", "h = { 'Access-Control-Allow-Origin': \"*\" }"], ["cors({ origin: 'x' })", "cors({ inner: { origin: true } })", "cors(x, { origin: true })"]),
    "ai/raw-sql-concatenation": (["db.query(`select ${id}`)", "this.db.execute(`a ${x} b`, y)", "pool.query('select ' + id)"], ["db.query(`select 1`)", "db.query('select 1', id)", "query(`a ${x}`)"]),
    "ai/express-no-helmet": (["const app = express()", "const a = express(); const b = express(); a.use(helmet())", "const app = express(); other.use(helmet())"], ["const app = express(); app.use(helmet())", "const app = express(options)", "app = express()"]),
    "ai/password-without-hashing": (["save({ password: req.body.password })", "user.password = request.body.password", "password = ctx.req.body.password"], ["password = hash(req.body.password)", "passwords = req.body.password"]),
    "ai/jwt-weak-secret": (["jwt.sign({ id: 1, a: [f(2)] }, 'secret')", "jwt.sign(user, \"x\")"], ["jwt.sign(user, secret)", "jwt.sign(user, 'x', {})", "jwt.sign('x')"]),
    "ai/unvalidated-redirect": (["res.redirect(req.query.next)", "res.redirect(a.b.body.url)"], ["res.redirect(check(req.query.next))", "res.redirect(req.query.next + 1)"]),
    "ai/exposed-admin-route": (["app.get('/admin/users', f)", "router.get(\"/debug/x\", g)"], ["app.get('/users', f)", "app.post('/admin/x', f)", "app.get('/admin', f)"]),
}


def over_lines(text):
    """The same tokens, three or more lines, with comments between."""
    out, strings = [], re.split(r"""('[^']*'|"[^"]*"|`[^`]*`)""", text)
    for k, piece in enumerate(strings):
        out.append(piece if k % 2 else re.sub(r"(?<=\w)\.(?=\w)|([(){}=,:+;])(?!=)", lambda m: f"\n{m.group()} // note 'it\n", piece))
    return "\n\n" + "".join(out)


def hits(spark, make_files, texts, ext="js"):
    files = make_files([("t", f"f{k}.{ext}", text) for k, text in enumerate(texts)])
    found: dict = {}
    for r in scan_syntax(files).collect():
        found.setdefault(int(re.sub(r"\D", "", r.file)), set()).add((r.rule_id, r.line))
    return found


def test_every_rule_on_a_line_over_lines_and_nowhere_else(spark, make_files):
    texts, wanted = [], []
    for rule, (good, bad) in CASES.items():
        for text in good:
            for form, line in ((text, 1), (over_lines(text), None), (f"/* {text} */ x = 1", 0), (f"// {text}", 0), (f"s = {'`' if '`' not in text else repr('')[0]}{text.replace(chr(39), chr(34))}{'`' if '`' not in text else repr('')[0]}", 0)):
                if "`" in text and form.startswith("s ="):
                    continue
                texts.append(form)
                wanted.append((rule, line))
        for text in bad:
            texts += [text, over_lines(text)]
            wanted += [(rule, 0)] * 2
    found = hits(spark, make_files, texts)
    for k, (rule, line) in enumerate(wanted):
        lines = [n for r, n in found.get(k, ()) if r == rule]
        assert (len(lines) == 1) == (line != 0), (rule, texts[k])
        if line is None:
            assert lines[0] >= 3
        elif line:
            assert lines == [line], (rule, texts[k])


def test_lines_of_the_first_token(spark, make_files):
    texts = ["a\n/* b\nc */ `x\ny` \nconst app\n= express()\n", "const a = express()\na.use(helmet())\n\nconst b =\n express()", "\n\nx = 1\nres\n.redirect(\nreq.query.u)"]
    found = hits(spark, make_files, texts)
    assert found == {0: {("ai/express-no-helmet", 5)}, 1: {("ai/express-no-helmet", 4)}, 2: {("ai/unvalidated-redirect", 4)}}
    found = hits(spark, make_files, ['"""\nKEY = "sk-1"\n"""\n# KEY = "sk-2"\nKEY \\\n = \'sk-3\'\nTOKEN = (\n  "ghp_x")\nOTHER = "ghp_y"'], "py")
    assert found == {0: {("ai/hardcoded-api-key-in-source", 9)}}


def test_hostile_and_odd_texts(spark, make_files):
    long = 200_000
    texts = ["", "\n", "'open = 'sk-x", "jwt.sign(" + "(" * 5000, "jwt.sign(" + "a, " * 20_000 + "'x')", "/*" + "*" * long, "'" + "\\'" * 50_000 + "' password", "x." * 50_000 + "get('/admin/', f)",
             "cors({" + "a: 1, " * 5000 + "origin: true })", "password = " + "a." * 3000 + "body.password", f"{OPEN}s/admin/{CLOSE} app.get('/admin/x{CLOSE}', f)"]
    found = hits(spark, make_files, texts)
    assert found.get(10) == {("ai/exposed-admin-route", 1)}
    assert ("ai/cors-allow-all-origins", 1) in found[8]
    files = make_files([("t", "a.js", "db.query(`a ${x}`)"), ("t", "node_modules/a.js", "db.query(`a ${x}`)"), ("t", "a.md", "db.query(`a ${x}`)")])
    assert rows(syntax_hits(files), "path", "line") == [("a.js", 1)]
    assert syntax_hits(files.limit(0)).count() == 0 and syntax_hits(files, []).count() == 0


def test_in_a_whole_scan(spark, make_files):
    files = make_files([("t", "a.js", "db\n.query(`a ${x}`)"), ("t", "b.js", "const a = express()")])
    plain, more = Engine(files=files, options=ScanOptions(deps=False)), Engine(files=files, options=ScanOptions(deps=False, syntax=True, min_severity="high"))
    assert not [r for r in plain.findings().collect() if r.rule_id.startswith("ai/")]
    assert rows(more.findings().filter("rule_id LIKE 'ai/%'"), "rule_id", "line") == [("ai/raw-sql-concatenation", 1)]


@pytest.mark.parametrize("text, tokens", [("a.b('x y', `t\n`) // c", ["a", ".", "b", "(", f"{OPEN}sx{BLANK}y{CLOSE}", ",", f"{OPEN}tt{BLANK}{CLOSE}", "\n", ")"]), ("", [])])
def test_tokens(spark, text, tokens):
    stream = spark.range(1).select(token_text(F.lit(text), "js").alias("s")).first().s
    assert [t for t in re.split(" +", stream) if t] == tokens
