from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from argusframe.schema import FILES, RESPONSES  # noqa: E402
from argusframe.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_files(spark):
    def make(rows):
        """Rows of (target, path, content) or (target, path, content, size)."""
        full = [(r[0], r[1], r[3] if len(r) > 3 else len(r[2].encode()), r[2]) for r in rows]
        return spark.createDataFrame(full, FILES)
    return make


@pytest.fixture(scope="session")
def make_responses(spark):
    def make(rows):
        """Rows of (target, kind, path, status, headers, body); https sites."""
        full = [(t, f"https://{t}.example", p, k, "GET", s, h, b) for t, k, p, s, h, b in rows]
        return spark.createDataFrame(full, RESPONSES)
    return make


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
