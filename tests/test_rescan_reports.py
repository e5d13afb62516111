from __future__ import annotations

import json
import pickle
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from argusframe.plans.documents import markdown_documents
from argusframe.plans.rescan import rescan
from argusframe.plans.scan import Engine, ScanOptions
from argusframe.sources.report_files import MANIFEST, folder_name, write_report_files


def tree(rng, n):
    scraps = ["eval(x)", "Math.random()", "password = 'hunter22'", "// note", "exec(`ls ${x}`)", "db = 'postgres://u:hunter2pw@host/db'", "plain"]
    files = [(f"t{k % 7}", f"src/f{k}.{rng.choice(['js', 'py', 'md'])}", "\n".join(rng.choices(scraps, k=rng.randint(0, 9)))) for k in range(n)]
    files += [(f"t{k}", "package.json", '{"dependencies": {"x": "*"}}') for k in range(7)]
    return files + [("t0", ".env", "A=1"), ("t1", ".env", "A=1"), ("t1", ".gitignore", ".env"), ("t2", "yarn.lock", ""), ("t3", "big.js", "x" * 1_100_000), ("t4", "node_modules/a.js", "eval(1)")]


def same(found: Engine, files, options):
    plain = Engine(files=files, options=options)
    assert rows(found.summary(), "*") == rows(plain.summary(), "*")
    assert rows(found.findings(), "*") == rows(plain.findings(), "*")
    assert rows(found.errors(), "*") == rows(plain.errors(), "*")
    plain.close()


def test_a_second_scan_searches_what_changed(spark, tmp_path, make_files):
    rng = random.Random(4)
    store, files = str(tmp_path / "store"), tree(rng, 400)
    first = rescan(make_files(files), store)
    different = {(p, c) for _, p, c in files}
    assert first.searched == (len(different), sum(len(c) for _, c in different))
    same(first.engine, make_files(files), ScanOptions())
    changed = [(t, p, c + "\neval(y)" if k % 100 == 3 else c) for k, (t, p, c) in enumerate(files) if k != 50]
    changed += [("copy", p, c) for t, p, c in files if t == "t0"]  # a new target with known texts
    second = rescan(make_files(changed), store)
    assert second.searched == (5, sum(len(c) for k, (_, _, c) in enumerate(changed) if changed[k] not in files and changed[k][0] != "copy"))
    same(second.engine, make_files(changed), ScanOptions())
    assert rescan(make_files(changed), store).searched == (0, 0)


def test_other_rules_search_again_and_broken_archives_are_not_kept(spark, tmp_path):
    store = str(tmp_path / "store")
    schema = "target_id string, path string, size_bytes long, content string"
    files = spark.createDataFrame([("a", "x.js", 7, "eval(1)"), ("b", None, None, None), ("c", None, None, "archive is too large")], schema)
    assert rescan(files, store).searched == (1, 7)
    few = ScanOptions(min_severity="critical")
    again = rescan(files, store, few)
    assert again.searched == (1, 7)
    same(again.engine, files, few)
    assert rescan(files.limit(0), store).engine.summary().count() == 0
    assert rescan(files.limit(0), str(tmp_path / "new")).engine.findings().count() == 0


def test_a_scan_killed_while_writing_is_not_believed(spark, tmp_path, make_files):
    store, files = tmp_path / "store", make_files([("a", "x.js", "eval(1)")])
    rescan(files, str(store))
    (marker,) = store.glob("*/scan=*/_SUCCESS")
    marker.unlink()
    assert rescan(files, str(store)).searched == (1, 7)
    same(rescan(files, str(store)).engine, files, ScanOptions())


def test_one_file_for_each_target(spark, tmp_path, make_files):
    files = [("one", "a.js", "\n".join(["eval(1)"])), ("one", "b.js", "eval(2)"), ("one", "c.js", "eval(3)"), ("a/b ü", "a.js", "eval(1)"), ("..", "a.txt", ""), ("x" * 300, "a.js", "eval(1)")]
    engine = Engine(files=make_files(files))
    summary, findings = engine.summary(), engine.findings()
    documents = markdown_documents(findings, summary, date="2026-01-01", part_rows=2).cache()
    assert documents.filter("target_id = 'one'").count() == 2
    out = tmp_path / "out"
    write_report_files(documents, str(out))
    wanted: dict = {}
    for r in documents.orderBy("target_id", "part").collect():
        wanted[r.target_id] = wanted.get(r.target_id, "") + r.text
    found = {p.relative_to(out).as_posix(): p.read_text() for p in out.rglob("*.md")}
    assert found == {f"{folder_name(t)}/security-report.md": text for t, text in wanted.items()}
    assert json.loads((out / MANIFEST).read_text())["files"] == 4
    assert sorted(p.name for p in out.iterdir()) == sorted([MANIFEST, *map(folder_name, wanted)])
    # again, after a job that was killed and left its staging folder
    (out / ".staging-lost").mkdir()
    (out / ".staging-lost" / "0").write_text("half")
    write_report_files(documents.filter("target_id = 'one'"), str(out), name="mine.txt")
    assert (out / "one" / "mine.txt").read_text() == wanted["one"] == (out / "one" / "security-report.md").read_text()
    assert not list(out.glob(".staging*"))


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    documents = spark.range(200).select(F.concat(F.lit("t"), "id").alias("target_id"), F.lit(0).alias("part"), F.when(F.col("id") == 150, F.raise_error(F.lit("no"))).otherwise("text").alias("text"))
    out = tmp_path / "out"
    with pytest.raises(Exception):
        write_report_files(documents, str(out))
    assert not out.exists() or not list(out.rglob("*"))
    write_report_files(documents.filter("id <> 150"), str(out))
    assert len(list(out.rglob("*.md"))) == 199
    write_report_files(documents.limit(0), str(tmp_path / "none"))
    assert json.loads((tmp_path / "none" / MANIFEST).read_text())["files"] == 0


def test_folder_names():
    assert folder_name(".") == "%2E" and folder_name("..") == "%2E%2E" and folder_name("a/b") == "a%2Fb" and folder_name(None) == folder_name("") == "%00"
    assert len(folder_name("é" * 500)) < 255 and folder_name("x" * 400 + "a") != folder_name("x" * 400 + "b")


def test_names_of_written_files_stay_out_of_the_driver(tmp_path):
    from argusframe.sources.report_files import ReportWriter
    from argusframe.sources.trees import side_by_side
    writer = ReportWriter(str(tmp_path), "j")
    few, many = (writer.write((f"{kind}{k} ü", "r.md", "x") for k in range(n)) for kind, n in (("a", 2), ("b", 500)))
    assert abs(len(pickle.dumps(many)) - len(pickle.dumps(few))) < 8
    writer.commit([few, None, many, writer.write(iter(()))])
    assert len(list(tmp_path.rglob("r.md"))) == json.loads((tmp_path / MANIFEST).read_text())["files"] == 502
    begun = []
    done = side_by_side(lambda x: begun.append(x) or x, range(10_000), 4)
    assert [next(done) for _ in range(3)] == [0, 1, 2] and len(begun) < 100
    assert sum(1 for _ in done) == 9_997
