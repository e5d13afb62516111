from __future__ import annotations

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from argusframe.operators.merge import EMISSION_ORDER, emission_order, filter_severity, order_by_severity
from argusframe.operators.score import preview_findings, score_targets
from argusframe.operators.skew import number_rows, salted_join
from argusframe.plans import documents as docs
from argusframe.plans.scan import Engine, ScanOptions
from argusframe.schema import FINDINGS

FIXTURE_JS = "const app = express();\napp.use(cors({ origin: \"*\", credentials: true }));\nconst r = eval(req.body.x);\napp.get('/debug/users', f);\n"


def finding(target, severity="high", category="code", n=0, file="f.js"):
    return (target, "sast", severity, category, f"t{n}", "d", file, n or None, "fix", f"r{n}", None, None, None, 4, n, 0)


def test_scores(spark):
    data = ([finding("secret", "critical", "secret")] + [finding("forty", "low", n=n) for n in range(40)]
            + [finding("more", "low", n=n) for n in range(41)] + [finding("info", "info")] + [finding("round", "high", "config", n) for n in range(10)])
    targets = spark.createDataFrame([(t,) for t in ("secret", "forty", "more", "info", "round", "none")], "target_id string")
    found = filter_severity(spark.createDataFrame(data, FINDINGS))
    assert rows(score_targets(found, targets), "target_id", "score", "grade", "report_grade", "total") == [
        ("forty", 76, "C", "B", 40), ("info", 100, "A", "A+", 0), ("more", 75, "C", "B", 41), ("none", 100, "A", "A+", 0),
        ("round", 28, "F", "F", 10), ("secret", 70, "C", "B", 1)]
    with pytest.raises(ValueError):
        filter_severity(found, "info")


def test_raising_the_threshold_never_lowers_the_number_of_targets_or_adds_findings(spark, make_files):
    files = make_files([("t", "a.js", FIXTURE_JS), ("u", "b.md", "x")])
    totals = []
    for level in ("low", "medium", "high", "critical"):
        summary = Engine(files=files, options=ScanOptions(min_severity=level)).summary()
        assert summary.count() == 2
        totals.append(summary.agg(F.sum("total")).first()[0])
    assert totals == sorted(totals, reverse=True)


def test_partitioning_and_union_of_targets_do_not_matter(spark, make_files):
    a, b = [("a", f"x{n}.js", FIXTURE_JS) for n in range(5)], [("b", "y.py", "os.system(1)"), ("b", ".env", "")]
    whole = rows(Engine(files=make_files(a + b).repartition(5)).findings(), "*")
    assert whole == sorted(rows(Engine(files=make_files(a)).findings(), "*") + rows(Engine(files=make_files(b)).findings(), "*"), key=repr)


def test_number_rows_of_a_hot_group(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"), (F.col("id") * 7919 % 500).alias("v"))
    out = number_rows(df, "g", ["v"], ranges=7).collect()
    by_group: dict = {}
    for r in out:
        by_group.setdefault(r.g, []).append((r.n, r.v))
    for group in by_group.values():
        group.sort()
        assert [n for n, _ in group] == list(range(1, len(group) + 1))
        assert [v for _, v in group] == sorted(v for _, v in group)
    assert len(out) == 2000


def test_salted_join_equals_join(spark):
    big = spark.range(500).select((F.col("id") % 4).alias("k"), F.col("id").alias("v"))
    small = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "k bigint, w string")
    for how in ("inner", "left", "left_semi"):
        assert rows(salted_join(big, small, ["k"], how), "*") == rows(big.join(small, "k", how), "*")


def test_orders_and_preview(spark):
    data = [finding("t", s, n=n) for n, s in enumerate(("low", "critical", "high", "critical"))]
    found = spark.createDataFrame(data, FINDINGS)
    assert [r.rule_id for r in order_by_severity(found).collect()] == ["r1", "r3", "r2", "r0"]
    assert [r.rule_id for r in emission_order(found).collect()] == ["r0", "r1", "r2", "r3"]
    top = preview_findings(found)
    assert rows(top, "rule_id", "remaining") == [("r0", 1), ("r1", 1), ("r2", 1)]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_documents_in_parts_read_on(spark):
    data = [finding("t", s, n=n) for n, s in enumerate(("low", "critical", "high", "critical", "low"), 1)] + [finding("one", file=None)]
    found = spark.createDataFrame(data, FINDINGS)
    targets = spark.createDataFrame([("t",), ("one",), ("none",)], "target_id string")
    summary = score_targets(found, targets).select("*", F.lit("code").alias("scan_type"), F.lit(3).cast("bigint").alias("scanned_files"), F.lit(1.0).alias("duration"))

    def whole(make, part_rows):
        texts: dict = {}
        for r in make(part_rows).orderBy("target_id", "part").collect():
            texts[r.target_id] = texts.get(r.target_id, "") + r.text
        return texts

    for make in (lambda n: docs.markdown_documents(found, summary, "2026-01-01", n), lambda n: docs.html_documents(found, summary, "2026-01-01", n),
                 lambda n: docs.json_documents(found, summary, n)):
        assert whole(make, 2) == whole(make, 100)
    md = whole(lambda n: docs.markdown_documents(found, summary, "2026-01-01", n), 2)
    assert md["t"].index("**t2**") < md["t"].index("**t4**") < md["t"].index("**t3**") < md["t"].index("**t1**") < md["t"].index("**t5**")
    assert md["t"].count("## critical: 2\n") == 1 and "Nothing was found." in md["none"] and " in `" not in md["one"]
    parsed = json.loads(whole(lambda n: docs.json_documents(found, summary, n), 2)["t"])
    assert [f["ruleId"] for f in parsed["findings"]] == ["r1", "r2", "r3", "r4", "r5"] and parsed["counts"]["critical"] == 2
    assert json.loads(whole(lambda n: docs.json_documents(found, summary, n), 2)["one"])["findings"][0]["file"] is None
    parts = docs.result_parts(found, summary, 2)
    assert rows(parts.selectExpr("target_id", "part", "size(findings) n"), "*") == [("none", 0, 0), ("one", 0, 1), ("t", 0, 2), ("t", 1, 2), ("t", 2, 1)]


def test_full_engine(spark, make_files, make_responses):
    files = make_files([("t", "a.js", FIXTURE_JS), ("t", "package.json", '{"dependencies":{"x":"*"}}'), ("t", ".env", "A=postgres://u:p@h/d")])
    reports = spark.createDataFrame([("t", "semgrep", '{"results":[{"check_id":"eval-usage","path":"a.js","start":{"line":3},"extra":{"severity":"ERROR"}}]}')],
                                    "target_id string, source string, json string")
    web = make_responses([("w", "main", "/", 200, {}, ""), ("x", "main", "/", None, None, None)])
    engine = Engine(files=files, responses=web, reports=reports)
    found = engine.findings()
    assert rows(found.filter("rule_id = 'eval-usage'"), "scanner") == [("semgrep",)]
    assert {r.scanner for r in found.collect()} == {"secrets", "deps", "semgrep", "sast", "web"}
    assert rows(engine.summary(found), "target_id", "scan_type", "scanned_files") == [("t", "code", 3), ("w", "web", 0)]
    assert rows(engine.errors(), "target_id", "scanner") == [("x", "web")]


def test_emission_order_is_total():
    assert {"file", "rule_ord", "seq", "line"} <= set(EMISSION_ORDER)


def test_rows_are_written_down_once_each(spark, monkeypatch):
    """Columns that rows are numbered by aren't copied beside them."""
    from argusframe.operators import skew
    written, cut = [], skew.cut_lineage
    monkeypatch.setattr(skew, "cut_lineage", lambda df: written.append(df.columns) or cut(df))
    df = spark.createDataFrame([("a", 3, "x"), ("a", None, "y"), ("b", 1, "z"), ("a", 1, "w"), ("a", 3, "u")], "g string, v int, t string")
    assert sorted((r.g, r.n, r.t) for r in number_rows(df, "g", ["v", F.col("t")], ranges=3).collect()) == [
        ("a", 1, "y"), ("a", 2, "w"), ("a", 3, "u"), ("a", 4, "x"), ("b", 1, "z")]
    assert written[0] == ["g", "v", "t", "_order1", "_tie"]
