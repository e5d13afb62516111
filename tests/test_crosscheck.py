"""Spark queries against plain SQL in DuckDB on the smallest tables. A chosen
part by default; all of them with CROSSCHECK=all."""

from __future__ import annotations

import os
import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = Path(os.environ.get("CROSSCHECK_DIR", "/root/testdata/sf0.001"))
CHOSEN = ("scan_summary", "scan_sources", "match_line_rules", "mask_secret", "merge_dependencies", "source_cascade", "scan_web", "score",
          "markdown_report", "html_report", "order_by_severity", "admit_url", "canonical_repo", "read_trivy_report", "findings_rollup", "dedup_findings")
NAMES = list(entry.oracle_sql()) if os.environ.get("CROSSCHECK") == "all" else CHOSEN

pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in SF_DIR.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, str(SF_DIR))
    columns = sorted(df.columns)
    found = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    wanted = duck.sql(entry.oracle_sql()[name])
    assert sorted(wanted.columns) == columns
    places = [wanted.columns.index(c) for c in columns]
    assert found == sorted((tuple(r[p] for p in places) for r in wanted.fetchall()), key=repr)


def test_every_query_but_few_has_sql():
    own = {name for name in entry.queries() if name != "pipeline" and not re.match(r"op\d+_", name)}  # the corpus queries have tests of their own
    assert own <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
