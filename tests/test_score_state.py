from __future__ import annotations

import random

import pandas as pd
import pytest
from conftest import rows

from argusframe.operators.merge import dedup_findings
from argusframe.plans.scan import Engine, ScanOptions
from argusframe.schema import FINDING_COLUMNS, FINDINGS, FILES, as_findings
from argusframe.streaming import score_state as live

BATCHES = [
    [("t", "a.js", "eval(1)"), ("t", ".env", "A=1"), ("u", "package.json", '{"dependencies": {"x": "*", "y": "git+z", "z": "latest"}}'), ("clean", "a.txt", "")],
    [("t", "b.js", "eval(2)\nMath.random()"), ("u", "c.py", "import pickle\npickle.loads(x)"), ("v", "s.js", "db = 'postgres://u:hunter2pw@host/db' + 'postgres://v:hunter3pw@host/db'"), ("w", None, "archive is broken")],
    [("t", ".gitignore", ".env\n"), ("u", "yarn.lock", ""), ("u", "requirements.txt", "a\nb==1\n"), ("w", "x.js", "eval(3)"), ("t", "deep/a.js", "eval(4)")],
    [("t", "a.js", "eval(1)"), ("u", "yarn.lock", "")],  # delivered again
]


def arrive(spark, batch, folder):
    full = [(t, p, len(c), c) for t, p, c in batch]
    schema = "target_id string, path string, size_bytes bigint, content string"
    spark.createDataFrame(full, schema).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(FILES).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("options", [ScanOptions(), ScanOptions(min_severity="high", secrets=False)])
def test_scores_of_each_batch_equal_one_scan(spark, tmp_path, options):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for k, batch in enumerate(BATCHES):
        arrive(spark, batch, source)
        if options.min_severity == "high" and k < len(BATCHES) - 1:  # all batches in one run, once
            continue
        live.start_live_scores(stream(spark, source), out, state, options).awaitTermination()
        unique = {(t, p): (t, p, c) for b in BATCHES[:k + 1] for t, p, c in b}
        files = spark.createDataFrame([(t, p, len(c), c) for t, p, c in unique.values()], "target_id string, path string, size_bytes bigint, content string")
        engine = Engine(files=files, options=options)
        assert rows(live.read_live_scores(spark, out), "*") == rows(engine.summary(), "*")
        wanted = engine.findings().filter("rule_id NOT IN ('env-not-gitignored', 'missing-lockfile')")
        assert rows(live.read_live_findings(spark, out), "*") == rows(wanted, "*")
        engine.close()
    if options.min_severity == "high":
        return
    touched = [{r.target_id for r in spark.read.parquet(f"{out}/scores/batch_id={k}").collect()} for k in range(3)]
    assert touched == [{"t", "u", "clean"}, {"t", "u", "v", "w"}, {"t", "u", "w"}]


def test_repeated_batch_changes_nothing(spark, tmp_path):
    """The queries fail after writing and before committing their last batch, and do it again."""
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for batch in BATCHES[:3]:
        arrive(spark, batch, source)
    live.start_live_scores(stream(spark, source), out, state).awaitTermination()
    before, found = rows(live.read_live_scores(spark, out), "*"), rows(live.read_live_findings(spark, out), "*")
    for query in ("evidence", "changes", "scores"):
        commits = sorted((tmp_path / "state" / query / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
        commits[-1].unlink()
        (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    live.start_live_scores(stream(spark, source), out, state).awaitTermination()
    assert rows(live.read_live_scores(spark, out), "*") == before
    assert rows(live.read_live_findings(spark, out), "*") == found


def test_late_better_finding_takes_the_first_back(spark, tmp_path):
    rng = random.Random(4)
    made = []
    for k in range(160):
        file, line, rule = rng.choice(["a.js", "b.js", None]), rng.choice([1, 2, None]), rng.choice(["r1", "r2", "", None])
        scanner = rng.choice(["semgrep", "sast"])
        made.append((rng.choice("tu"), scanner, rng.choice(["low", "high", "critical"]), "code", f"title {k % 5}", f"text {k}", file, line, rule, 3 if scanner == "semgrep" else 4, rng.choice([1, 2, None]), k))
    schema = "target_id string, scanner string, severity string, category string, title string, description string, file string, line int, rule_id string, scanner_ord int, rule_ord int, seq int"
    whole = as_findings(spark.createDataFrame(made, schema))
    for k in range(4):
        as_findings(spark.createDataFrame(made[k::4], schema)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(FINDINGS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live.start_dedup(arriving, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    stored = spark.read.schema(live.CHANGES).parquet(str(tmp_path / "out"))
    assert stored.filter("sign = -1").count() > 0
    assert rows(live.standing_findings(stored), *FINDING_COLUMNS) == rows(dedup_findings(whole), *FINDING_COLUMNS)
    sums = live.target_sums(stored).select("target_id", "critical", "high", "low", "total")
    plain = dedup_findings(whole).groupBy("target_id").pivot("severity", ["critical", "high", "low"]).count().fillna(0)
    assert rows(sums, "target_id", "critical", "high", "low") == rows(plain, "target_id", "critical", "high", "low")


def test_nothing_arrives(spark, tmp_path):
    spark.createDataFrame([], FILES).coalesce(1).write.parquet(str(tmp_path / "in"))
    live.start_live_scores(stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert not (tmp_path / "out" / "changes").exists() or spark.read.schema(live.CHANGES).parquet(str(tmp_path / "out" / "changes")).count() == 0


class _Counted:
    """State in a dictionary that counts the calls."""

    def __init__(self):
        self.values, self.calls = {}, 0

    def getValueState(self, *_):
        return self

    getMapState = getValueState

    def get(self):
        self.calls += 1
        return self.values.get("size")

    def update(self, value):
        self.calls += 1
        self.values["size"] = value

    def getValue(self, key):
        self.calls += 1
        return self.values.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.values[key] = value


def test_state_is_called_for_bundles_of_facts():
    rng, state, stands, net = random.Random(5), _Counted(), {}, {}
    columns = ["target_id", "path", "id", "deal", *live._RANK, "kind", "payload"]
    for size in (1, 300, 5000, 40):  # bundles are doubled in the second and third batch
        batch = []
        for _ in range(size):
            k, rank = rng.randrange(9000), rng.randrange(50)
            batch.append((f"t{k % 3}", "a.js", str(k), hash((k, 1)) * 0x9E3779B97F4A7C15 % (1 << 64) - (1 << 63), rank, 0, 0, "", "", "finding", f"{k} {rank}"))
            stands[k] = min(stands.get(k, 50), rank)
        state.calls, keeper = 0, live._KeepBest()
        keeper.init(state)
        for changes in keeper.handleInputRows((0,), iter([pd.DataFrame(batch[:size // 2], columns=columns), pd.DataFrame(batch[size // 2:], columns=columns)]), None):
            for payload, sign in zip(changes["payload"], changes["sign"]):
                net[payload] = net.get(payload, 0) + sign
        assert state.calls <= 2 * size + 4 and (size < 1000 or state.calls < size / 10)
        assert {p for p, n in net.items() if n} == {f"{k} {rank}" for k, rank in stands.items()} and set(net.values()) <= {0, 1}
