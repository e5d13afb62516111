from __future__ import annotations

import pickle
import zlib
from pathlib import Path

from conftest import rows
from crosscheck.queries import _land
from pyspark.sql import functions as F

from argusframe.operators.merge import dedup_findings, source_cascade
from argusframe.operators.score import findings_rollup, score_targets
from argusframe.operators.skew import number_rows
from argusframe.plans.documents import write_json_results
from argusframe.plans.evidence import EVIDENCE, write_evidence
from argusframe.schema import FINDING_COLUMNS, FINDINGS
from argusframe.session import CLEAN_SHUFFLES, ensure_checkpoint_dir, shuffles_dropped, write_down
from argusframe.sources.results import read_json_results
from argusframe.streaming import score_state as live


def _bytes(folder) -> int:
    return sum(p.stat().st_size for p in Path(folder).rglob("*") if p.is_file())


def _kept(spark) -> dict[str, int]:
    """Bytes of each folder below the checkpoint folder."""
    return {p.name: _bytes(p) for p in Path(ensure_checkpoint_dir(spark).removeprefix("file:")).iterdir()}


def test_stream_input_lands_in_files_that_follow_the_shuffle_width(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        each = _land(spark.range(1000), str(tmp_path / "in"), 2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert each == 6 and len(list((tmp_path / "in").glob("*.parquet"))) == 12
    assert spark.read.parquet(str(tmp_path / "in")).count() == 1000


def test_rollup_starts_from_written_counts(spark):
    found = spark.createDataFrame([("t", "sast", "low"), ("t", "sast", "low"), ("t", "deps", "high")], "target_id string, scanner string, severity string")
    levels = findings_rollup(found)
    assert levels.count() == 6 and levels.filter("target_id IS NULL").first().findings == 3
    plan = levels._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1  # the counts' own table is gone when the levels are built


def test_numbered_rows_are_written_in_columns_and_once(spark):
    wide = spark.range(20_000, numPartitions=4).select(
        F.concat(F.lit("t"), F.col("id") % 50).alias("g"), (F.col("id") * 7919 % 1000).alias("v"),
        *[F.concat(F.lit(f"text {k} of many words that many rows share, "), F.col("id") % 9).alias(f"c{k}") for k in range(8)])
    before = _kept(spark)
    numbered = number_rows(wide, "g", ["v"], ranges=5)
    new = {k: n for k, n in _kept(spark).items() if k not in before}
    assert len(new) == 1 and sum(new.values()) < 20_000 * 20  # a checkpoint has over 100 bytes for each row, twice
    wanted = wide.groupBy("g").agg(F.sort_array(F.collect_list("v")).alias("v")).select("g", F.posexplode("v")).select("g", F.col("pos") + 1, "col")
    assert rows(numbered.select("g", F.col("n").cast("int"), "v"), "*") == rows(wanted, "*")


def test_what_parquet_cannot_hold_is_written_down_too(spark):
    for df in (spark.sql("SELECT 1 a, NULL b"), spark.sql("SELECT 1 a, 2 A"), spark.sql("SELECT make_interval(1) a"), spark.sql("SELECT named_struct('a', NULL) s"),
               spark.sql("SELECT 1 a WHERE false"), spark.sql("SELECT map('k', parse_json('{\"a\": [1, null]}'), 'n', CAST(NULL AS VARIANT)) m, CAST(NULL AS STRING) s")):
        text = lambda d: d.toJSON().collect()
        assert text(write_down(df)) == text(df) and write_down(df).dtypes == df.dtypes


def _shuffle_files(spark) -> set[Path]:
    return {p for d in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString() for p in Path(d).rglob("shuffle_*.data")}


def test_shuffles_go_when_rows_are_written(spark, tmp_path):
    before = spark.conf.get(CLEAN_SHUFFLES)
    shuffled = spark.range(5000).repartition(7, "id")
    have = _shuffle_files(spark)
    with shuffles_dropped(spark):
        shuffled.write.parquet(str(tmp_path / "out"))
    assert _shuffle_files(spark) <= have and spark.conf.get(CLEAN_SHUFFLES) == before
    assert spark.read.parquet(str(tmp_path / "out")).count() == shuffled.count() == 5000


def test_json_results_are_compressed_and_whole(spark, tmp_path):
    made = [("t" if k % 3 else "u", "sast", "high", "code", f"title {k}", "text", "a.js", k, "fix", f"r{k}", None, None, None, 4, k, 0) for k in range(3000)]
    found = spark.createDataFrame(made, FINDINGS)
    targets = spark.createDataFrame([("t",), ("u",), ("none",)], "target_id string")
    summary = score_targets(found, targets).select("*", F.lit("code").alias("scan_type"), F.lit(3).cast("bigint").alias("scanned_files"), F.lit(1.0).alias("duration"))
    out = str(tmp_path / "out")
    write_json_results(found, summary, out, part_rows=700)
    assert list(Path(out).glob("part-*")) and all(p.name.endswith(".json.gz") for p in Path(out).glob("part-*"))
    assert _bytes(out) < 3000 * 60  # 200 as plain text
    back = read_json_results(spark, out)
    assert rows(back.select("target_id", "part", F.size("findings")), "*") == [
        ("none", 0, 0), ("t", 0, 700), ("t", 1, 700), ("t", 2, 600), ("u", 0, 700), ("u", 1, 300)]
    lines = back.select(F.explode("findings.line").alias("line"))
    assert sorted(r.line for r in lines.collect()) == list(range(3000))


def test_scan_keeps_neither_shuffles_nor_plain_reports(spark, tmp_path):
    have, before = _shuffle_files(spark), _kept(spark)
    columns = [c.split()[0] for c in EVIDENCE.split(", ")]
    values = {"target_id": F.concat(F.lit("t"), "id"), "path": F.lit("package-lock.json"), "size_bytes": F.lit(2), "content": F.lit("{}"), "kind": F.lit("root")}
    made = spark.range(500).repartition(3, "id").select(*[values.get(c, F.lit(None).cast("int")).alias(c) for c in columns])
    write_evidence(made, str(tmp_path / "evidence"))
    assert _shuffle_files(spark) <= have
    entry = '"left-pad-{}": {{"severity": "high", "via": [{{"title": "a flaw that is told at some length"}}], "fixAvailable": {{"name": "x"}}}}'
    json = '{"vulnerabilities": {' + ", ".join(entry.format(k) for k in range(20)) + "}}"
    reports = spark.range(500).repartition(3, "id").select(F.concat(F.lit("t"), "id").alias("target_id"), F.lit("npm-audit").alias("source"), F.lit(json).alias("json"))
    found = source_cascade(spark.read.parquet(str(tmp_path / "evidence")).select("target_id", "path", "size_bytes", "content"), reports)
    new = {k: n for k, n in _kept(spark).items() if k not in before}
    assert all(k.startswith("rows-") for k in new) and sum(new.values()) < 500 * 500
    assert _shuffle_files(spark) <= have
    assert found.groupBy("scanner").count().collect() == [("npm-audit", 10_000)]


def test_stream_keeps_no_shuffles_and_packs_what_it_writes(spark, tmp_path):
    made = [(f"t{k % 9}", "sast", "high", "code", f"title {k}", "text", "a.js", k % 600, "fix", None, None, None, None, 4, k, 0) for k in range(900)]
    findings = spark.createDataFrame(made, FINDINGS)
    have, source, out = _shuffle_files(spark), str(tmp_path / "in"), str(tmp_path / "out")
    each = _land(findings, source, 3, "description", "seq")
    assert _shuffle_files(spark) <= have
    arriving = spark.readStream.schema(FINDINGS).option("maxFilesPerTrigger", each).parquet(source)
    live.start_dedup(arriving, out, str(tmp_path / "state")).awaitTermination()
    assert _shuffle_files(spark) <= have
    assert all(".zstd." in p.name for folder in (source, out) for p in Path(folder).glob("part-*"))
    stands = live.standing_findings(spark.read.schema(live.CHANGES).parquet(out))
    assert rows(stands, *FINDING_COLUMNS) == rows(dedup_findings(findings), *FINDING_COLUMNS)


def test_bundles_of_facts_are_small_and_older_ones_are_read():
    facts = {(f"order-{k * 7919 % 9973}", f"src/f{k % 97}.js", f'{{"line":{k % 50}}}'): (k * 0x9E3779B97F4A7C15 % (1 << 63), [k % 5, k % 7, k * 31 % 9999, f"=title {k % 50}", f"=text {k}", "finding", f'{{"title":"title {k % 50}","description":"text {k}"}}']) for k in range(48)}
    old = zlib.compress(pickle.dumps(facts), 1)
    assert live._unpacked(live._packed(facts)) == live._unpacked(old) == facts and live._unpacked(live._packed({})) == {}
    assert len(live._packed(facts)) < 0.92 * len(old)
