from __future__ import annotations

import random
import re

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from argusframe.operators import rule_index as ri
from argusframe.operators.files import prune_paths, size_cap
from argusframe.operators.rules import FILE, LINE, RULES
from argusframe.operators.sast import match_rule_table, report_rules
from argusframe.sources.rule_catalog import register_rules

SCHEMA = "id string, severity string, extension string, scope string, pattern string, anti string, title string, description string, recommendation string"


def table(spark, rules):
    return spark.createDataFrame([(i, sev, ext, scope, p, anti, "t", "d", "r") for i, sev, ext, scope, p, anti in rules], SCHEMA)


def plain(files, index):
    return report_rules(ri.match_all(size_cap(prune_paths(files)), index.entries, index.rules), index.rules)


@pytest.mark.parametrize("pattern, texts", [
    (r"\beval\s*\(", {"eval"}), (r"exec\(|Spawn\(", {"exec(", "spawn("}), (r"(?i)PassWord\s*=", {"password"}), (r"(?:foo)+barn", {"barn"}),
    (r"(?:abc|de)x{2}yyy", {"yyy"}), (r"a(bcd)ef", {"abcdef"}), (r"x*|never", None), (r"^\s+$", None), (r"[Pp]assword", {"assword"}),
    (r"\Qa.b.c\E", None), (r"\p{Lu}ongword", None), (r"[a-z&&[^b]]cde]", None), (r"é\w+total", {"total"}), (r"(?=look)ahead", {"ahead"}), (r"(?!never)\w+gone", {"gone"}), (r"(unclosed", None),
])
def test_required_texts(pattern, texts):
    found = ri.required_texts(pattern)
    assert (set(found) if found else None) == texts


_ATOMS = st.sampled_from(["a", "B", "ab", "abc", r"\w", r"\s*", ".", "[ab]", "x?", "(?:abc|bca)", "(cab)+", "b{2}", "(?:ab|c)*", "(?i:ABC)", "a|bbb", "^", "$", "é", "(?=a)"])


@settings(max_examples=300)
@given(st.lists(_ATOMS, min_size=1, max_size=5), st.text("abcABCxé ", max_size=12))
def test_a_match_holds_a_required_text(parts, text):
    pattern = "".join(parts)
    found = ri.required_texts(pattern)
    if found and re.search(pattern, text):
        assert any(t in ri.lowered(text) for t in found)


def test_built_in_patterns_as_a_table(spark, make_files):
    rng = random.Random(2)
    scraps = ["eval(x)", "Math.random()", "password = 'hunter22'", "app.get('/admin')", "// eval(1)", "exec(`ls ${x}`)", "yaml.load(f)", "md5", "\t", "verify=False", "express()", "helmet", "== req.a", "plain text", "é"]
    files = [("t", f"f{k}.{rng.choice(['js', 'ts', 'py', 'md'])}", "\n".join(rng.choice(scraps) + rng.choice(["", " ", ";"]) for _ in range(rng.randint(0, 30)))) for k in range(60)]
    files += [("u", "test/a.js", "eval(1)"), ("u", "b.js", ""), ("u", "c.js", "\n\n"), ("u", "d.js", "eval(1)" * 3000)]
    rules = [(r.id, r.severity, e, r.scope, r.java, r.java_anti) for r in RULES if r.scope in (LINE, FILE) for e in r.extensions]
    index = ri.index_rules(table(spark, rules))
    assert sum(e[3] is not None for e in index.entries) > len(index.entries) / 2
    got = make_files(files)
    assert rows(ri.match_rule_index(got, index), "*") == rows(plain(got, index), "*")


def test_ten_thousand_rules_cost_their_candidates(spark, make_files):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    names = [word() for _ in range(10_000)]
    rules = [(f"r{k}", "low", rng.choice([".js", ".py"]), LINE if k % 9 else FILE, rf"\b{w}\s*\(" if k % 3 else rf"(?:{w}|{w[::-1]})\w*=", "safe" if k % 18 == 0 else None) for k, w in enumerate(names)]
    rules += [("any", "low", ".js", LINE, r"\)\s*;\s*\)", None)]
    files = [("t", f"f{k}.{'js' if k % 2 else 'py'}", "\n".join(" ".join([word(), rng.choice(names) + rng.choice(["(", "=", " (", ""])]) for _ in range(40)) + ("\nsafe" if k % 5 == 0 else "")) for k in range(60)]
    index = ri.index_rules(table(spark, rules))
    got = make_files(files)
    found = ri.candidates(got, index)
    pairs, hits = found.count(), ri.match_rule_index(got, index).count()
    assert 200 < hits <= pairs < 60 * 60  # of 300,000 pairs of a file and a rule
    some = ri.RuleIndex(index.rules, [e for e in index.entries if e[0] % 25 == 0])
    assert rows(ri.match_rule_index(got, some), "*") == rows(plain(got, some), "*")


def test_bad_tables_are_refused_at_load(spark):
    good = ("a", "low", ".js", LINE, "x+y", None)
    for bad, reason in (
        (("b", "low", ".js", LINE, "(open", None), "rule b: "), (("b", "low", ".js", LINE, "x", "[a-"), "rule b: "), (("b", "low", ".js", LINE, r"\p{Nothing}", None), "rule b: "),
        (("b", "low", ".js", LINE, "x*", None), "matches an empty line"), (("b", "grave", ".js", LINE, "x", None), "unknown severity"), (("b", "low", ".js", "word", "x", None), "unknown scope"),
        (("a", "high", ".js", LINE, "x+y", None), "id used twice"), ((None, "low", ".js", LINE, "x", None), "needs an id"),
    ):
        with pytest.raises(ValueError, match=re.escape(reason)):
            register_rules(table(spark, [good, bad]))
    fine = register_rules(table(spark, [good, good, ("a", "low", ".ts", LINE, "x+y", None), ("f", "low", None, FILE, r"\p{Lu}x*", None), ("e", "low", ".js", FILE, "x*", None)]))
    assert len(ri.index_rules(fine).rules) == 3


def test_odd_tables_and_files(spark, make_files):
    files = make_files([("t", "a.js", "foo(1)\nFOO(2)"), ("t", "b", "foo(")])
    assert match_rule_table(files, table(spark, [])).count() == 0
    assert match_rule_table(files.limit(0), table(spark, [("a", "low", ".js", LINE, "foo", None)])).count() == 0
    got = match_rule_table(files, table(spark, [("a", "low", ".js", LINE, "foo", None), ("b", "low", ".js", LINE, "(?i)2|foo.2", None), ("c", "low", ".js", FILE, "FOO", "foo")]))
    assert rows(got, "rule_id", "file", "line") == [("a", "a.js", 1), ("b", "a.js", 2)]
