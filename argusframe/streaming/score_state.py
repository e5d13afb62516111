"""Findings and scores that are kept up to date as files arrive.

Three queries hand on to each other through tables that are written exactly once:

1. *evidence*: the files of a batch, taken apart (texts are read here, and only here);
2. *changes*: one fact for each finding, file and root file, kept in state under its key. Of findings with one key the
   state holds the best-ranked one. A better one that comes late takes the first one back (sign -1) and puts itself (sign 1) in its place;
   a fact that is known already changes nothing, so a file that is delivered again doesn't count twice;
3. *scores*: sums of signed facts for each target, from which the targets of the batch get new scores.

Facts are spread by their keys, and sums are partial before the shuffle, so a target with very many files is no hot spot.
State is in RocksDB under the checkpoint folder, and a batch that is repeated starts from the state before it.
"""

from __future__ import annotations

import pickle
import sys
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from argusframe.functions.severity import SEVERITIES, category_multiplier, severity_weight
from argusframe.operators.deps import LOCK_FILES, PACKAGE_MANIFEST, built_in_findings, readable_manifests
from argusframe.operators.merge import filter_severity, union_scanners
from argusframe.operators.rules import RULES_BY_ID
from argusframe.operators.sast import report_rules
from argusframe.operators.score import grade_json, grade_report, score_value
from argusframe.operators.secrets import report_secrets
from argusframe.plans.evidence import EVIDENCE
from argusframe.plans.scan import Engine, ScanOptions
from argusframe.schema import FINDING_COLUMNS, FINDINGS
from argusframe.session import shuffles_dropped

# Workers get the functions of this module with the job, not by import.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
CHANGES = "kind string, target_id string, sign int, payload string"
_RANK = ("r1", "r2", "r3", "r4", "r5")
_BEFORE_ALL = -(1 << 40)
SLOTS = 512
#: Facts that are read and written together in the state, and rows of changes that leave a slot together.
BUNDLE = 64
CHANGES_AT_ONCE = 10_000
# What makes a finding one of its own: in merged reports, and where each finding of a file stands for itself.
DOUBLES = ("line", "key")
SELVES = ("scanner", "line", "key", "rule_ord", "seq", "title", "description")


def finding_facts(findings: DataFrame, identity: tuple[str, ...] = DOUBLES) -> DataFrame:
    """A fact for each finding; with ``DOUBLES`` its key and rank are those of ``dedup_findings``."""
    key = F.coalesce(F.when(F.col("rule_id") != "", F.col("rule_id")), F.col("title"))
    number = [F.coalesce(F.col(c).cast("long"), F.lit(_BEFORE_ALL)).alias(r) for c, r in zip(("scanner_ord", "rule_ord", "seq"), _RANK)]
    text = [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")).alias(r) for c, r in zip(("title", "description"), _RANK[3:])]
    known = [key.alias("key") if c == "key" else F.col(c) for c in identity]
    return findings.select("target_id", F.col("file").alias("path"), F.to_json(F.struct(*known)).alias("id"), *number, *text,
                           F.lit("finding").alias("kind"), F.to_json(F.struct(*FINDING_COLUMNS)).alias("payload"))


def _plain_facts(rows: DataFrame, kind: str, payload: Column) -> DataFrame:
    """Facts that have one form only: the first one stays."""
    zero = [F.lit(0).cast("long").alias(r) for r in _RANK[:3]] + [F.lit("").alias(r) for r in _RANK[3:]]
    return rows.select("target_id", "path", F.lit(kind).alias("id"), *zero, F.lit(kind).alias("kind"), payload.alias("payload"))


def _flag() -> Column:
    """What a root file says about its target."""
    path = F.col("path")
    return F.to_json(F.struct(F.when(path == ".env", "env").when((path == ".gitignore") & F.contains("content", F.lit(".env")), "covers")
                              .when(path == ".gitignore", "list").when(path.isin(*LOCK_FILES), "locked").alias("flag")))


def evidence_facts(evidence: DataFrame, options: ScanOptions) -> DataFrame:
    """All facts of a table or stream of evidence; no shuffle."""
    of = lambda kind: evidence.filter(F.col("kind") == kind)
    roots = of("root").select("target_id", "path", "size_bytes", "content")
    findings = []
    if options.secrets:
        findings.append(report_secrets(of("secret").select("target_id", "path", "rule_ord", "line", "seq", "secret")))
    if options.sast:
        findings.append(report_rules(of("rule").select("target_id", "path", "rule_ord", "line"), options.rules))
    if options.deps:
        findings.append(built_in_findings(roots))
    parts = [
        _plain_facts(of("file"), "file", F.to_json(F.struct(F.col("line").alias("counted")))),
        _plain_facts(of("broken").withColumn("path", F.lit(None).cast("string")), "broken", F.to_json(F.struct(F.lit("broken").alias("flag")))),
        _plain_facts(roots.filter(F.col("path").isin(".env", ".gitignore", *LOCK_FILES)), "root", _flag()),
    ]
    if options.deps:
        parts.append(_plain_facts(readable_manifests(roots).withColumn("path", F.lit(PACKAGE_MANIFEST)), "manifest", F.to_json(F.struct(F.lit("manifest").alias("flag")))))
    if findings:
        parts.append(finding_facts(filter_severity(union_scanners(findings), options.min_severity), SELVES))
    facts = parts[0]
    for part in parts[1:]:
        facts = facts.unionByName(part)
    return facts


def _packed(bundle: dict) -> bytes:
    """A bundle as it is stored, by zstd; the state keeps the bundles of many batches."""
    raw = pickle.dumps(bundle)
    return b"Z" + len(raw).to_bytes(8, "big") + pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def _unpacked(stored: bytes) -> dict:
    """Bundles of older states are by zlib."""
    if stored[:1] != b"Z":
        return pickle.loads(zlib.decompress(stored))
    return pickle.loads(pa.decompress(stored[9:], int.from_bytes(stored[1:9], "big"), codec="zstd", asbytes=True))


class _KeepBest(StatefulProcessor):
    """The best fact of each key so far is in state; what changes is passed on with a sign.

    A call into the state costs as much as ten facts or more in Python, so facts are held in bundles of about ``BUNDLE``, dealt by the hash of their
    key: a batch reads and writes the bundles it meets. A slot that outgrows its bundles doubles them, so a fact is dealt again less than twice on average."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.size = handle.getValueState("size", "facts bigint, bundles int")
        self.bundles = handle.getMapState("bundles", "number int", "facts binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        size = self.size.get()
        held, n = size if size is not None else (0, 1)
        arrived: dict[int, dict[tuple, tuple]] = {}
        for frame in rows:
            facts = zip(*(frame[c].tolist() for c in ("target_id", "path", "id", "deal", *_RANK, "kind", "payload")))
            for target, path, id_, deal, *fact in facts:
                bundle = arrived.setdefault(deal % n, {})
                best = bundle.get((target, path, id_))
                if best is None or fact[:5] < best[1][:5]:
                    bundle[target, path, id_] = (deal, fact)
        parts = 1
        while n * parts * BUNDLE < held + sum(map(len, arrived.values())):
            parts *= 2
        changes = []
        for number in sorted(arrived) if parts == 1 else range(n):
            stored = self.bundles.getValue((number,)) if held else None
            known = _unpacked(stored[0]) if stored is not None else {}
            before, first = len(known), len(changes)
            for at, (deal, fact) in arrived.get(number, {}).items():
                best = known.get(at)
                if best is not None and fact[:5] >= best[1][:5]:
                    continue
                if best is not None:
                    changes.append((best[1][5], at[0], -1, best[1][6]))
                changes.append((fact[5], at[0], 1, fact[6]))
                known[at] = (deal, fact)
            held += len(known) - before
            if parts > 1 or len(changes) > first:
                dealt: list[dict] = [{} for _ in range(parts)]
                for at, fact in known.items():
                    dealt[fact[0] % (n * parts) // n][at] = fact
                for k, bundle in enumerate(dealt):
                    if bundle or (k == 0 and before):
                        self.bundles.updateValue((number + k * n,), (_packed(bundle),))
            if len(changes) >= CHANGES_AT_ONCE:
                yield pd.DataFrame(changes, columns=["kind", "target_id", "sign", "payload"])
                changes = []
        self.size.update((held, n * parts))
        if changes:
            yield pd.DataFrame(changes, columns=["kind", "target_id", "sign", "payload"])

    def close(self) -> None:
        pass


def fact_changes(facts: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``(kind, target_id, sign, payload)``: what each batch of a stream of facts changes in all facts so far.

    Facts are dealt to ``slots`` by their whole keys, so few calls take many facts and neither a target nor a file is in one task; state is kept, read and
    written in bundles of facts. The number of slots is part of the state: keep it for the life of a checkpoint."""
    keyed = facts.withColumn("path", F.coalesce("path", F.lit("")))
    dealt = keyed.withColumn("slot", F.pmod(F.xxhash64("target_id", "path", "id"), F.lit(slots)).cast("int")).withColumn("deal", F.xxhash64("target_id", "path", "id", F.lit("bundle")))
    return dealt.groupBy("slot").transformWithStateInPandas(_KeepBest(), CHANGES, "Append", "None")


def dedup_stream(findings: DataFrame) -> DataFrame:
    """``dedup_findings`` over all batches of a stream: signed changes, see ``standing_findings``."""
    return fact_changes(finding_facts(findings))


def standing_findings(changes: DataFrame) -> DataFrame:
    """The findings that stand after all changes; signs of a finding add up to 0 or 1."""
    net = changes.filter("kind = 'finding'").groupBy("payload").agg(F.sum("sign").alias("sign")).filter("sign > 0")
    return net.select(F.from_json("payload", FINDINGS).alias("f")).select("f.*")


def target_sums(changes: DataFrame) -> DataFrame:
    """Counts, penalty and flags of each target; a stream of changes keeps them as its state."""
    fact = F.from_json("payload", "severity string, category string, counted int, flag string")
    rows = changes.select("kind", "target_id", "sign", fact.alias("fact"))
    sign, is_finding = F.col("sign"), F.col("kind") == "finding"
    weight = (severity_weight(F.col("fact.severity")) * category_multiplier(F.col("fact.category"))).cast("decimal(10,1)")
    counts = [F.sum(F.when(is_finding & (F.col("fact.severity") == s), sign).otherwise(0)).alias(s) for s in SEVERITIES]
    flags = [F.max(F.coalesce(F.col("fact.flag") == f, F.lit(False))).alias(f) for f in ("env", "list", "covers", "manifest", "locked", "broken")]
    return rows.groupBy("target_id").agg(
        *counts, F.sum(F.when(is_finding, sign).otherwise(0)).alias("total"),
        F.coalesce(F.sum(F.when(is_finding, (weight * sign).cast("decimal(10,1)"))), F.lit(0)).cast("decimal(20,1)").alias("penalty"),
        F.sum(F.when(F.col("kind") == "file", F.col("fact.counted") * sign).otherwise(0)).alias("scanned_files"), *flags)


def sums_to_scores(sums: DataFrame, options: ScanOptions) -> DataFrame:
    """The columns of ``Engine.summary`` and ``broken``. The two findings that a target has for want of a file are added here, where it is known what it has."""
    late = []
    if options.sast:
        late.append((F.col("env") & ~F.col("covers"), RULES_BY_ID["env-not-gitignored"].severity, "config"))
    if options.deps:
        late.append((F.col("manifest") & ~F.col("locked"), "medium", "dependency"))
    kept = SEVERITIES[: SEVERITIES.index(options.min_severity) + 1]
    late = [(test.cast("int"), severity, category) for test, severity, category in late if severity in kept]
    count = {s: sum((test for test, severity, _ in late if severity == s), F.col(s)) for s in SEVERITIES}
    total = sum((test for test, _, _ in late), F.col("total"))
    penalty = F.col("penalty")
    for test, severity, category in late:
        one = (severity_weight(F.lit(severity)) * category_multiplier(F.lit(category))).cast("decimal(10,1)")
        penalty = (penalty + (one * test).cast("decimal(10,1)")).cast("decimal(20,1)")
    rows = sums.select("target_id", "scanned_files", "broken", score_value(penalty, total).alias("score"), *[count[s].alias(s) for s in SEVERITIES], total.alias("total"))
    return rows.select("target_id", F.lit("code").alias("scan_type"), "score", grade_json(F.col("score")).alias("grade"), grade_report(F.col("score")).alias("report_grade"),
                       *SEVERITIES, "total", F.col("scanned_files").cast("bigint").alias("scanned_files"), F.lit(0.0).alias("duration"), "broken")


class LiveScores:
    """The three queries of a score stream. With ``available_now`` each one works through what the one before it left."""

    def __init__(self, starts: list[Callable[[], StreamingQuery]], in_turn: bool):
        self._waiting = starts if in_turn else []
        self.queries = [] if in_turn else [start() for start in starts]

    def awaitTermination(self) -> None:
        for start in self._waiting:
            self.queries.append(start())
            self.queries[-1].awaitTermination()
        self._waiting = []
        for query in self.queries:
            query.awaitTermination()

    def stop(self) -> None:
        for query in self.queries:
            query.stop()


def _with_rocks(spark: SparkSession, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Start a query whose state may outgrow the memory of an executor. It takes the settings of its start, so the shuffle of a batch goes with the batch."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        with shuffles_dropped(spark):
            return start()
    finally:
        spark.conf.set(PROVIDER, before)


def _make_folder(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)


def start_live_scores(files: DataFrame, out: str, checkpoint: str, options: ScanOptions | None = None, available_now: bool = True) -> LiveScores:
    """Scores of every target as its files arrive, below ``out``; see ``read_live_scores`` and ``read_live_findings``.

    ``files`` is a stream of files. A batch leaves the new scores of the targets it touches in ``out/scores/batch_id=N``.
    """
    spark, options = files.sparkSession, options or ScanOptions()

    def run(stream: DataFrame, name: str, write=None) -> StreamingQuery:
        writer = stream.writeStream.option("checkpointLocation", f"{checkpoint}/{name}").queryName(name)
        writer = writer.trigger(availableNow=True) if available_now else writer
        if write is not None:
            return _with_rocks(spark, lambda: writer.outputMode("update").foreachBatch(write).start())
        writer = writer.format("parquet").option("compression", "zstd").option("path", f"{out}/{name}").outputMode("append")
        return _with_rocks(spark, (writer.partitionBy("kind") if name == "evidence" else writer).start)

    def evidence() -> StreamingQuery:
        return run(Engine(files=files, options=options).plan_evidence(), "evidence")

    def changes() -> StreamingQuery:
        _make_folder(spark, f"{out}/evidence")
        stream = spark.readStream.schema(EVIDENCE).parquet(f"{out}/evidence")
        return run(fact_changes(evidence_facts(stream, options)), "changes")

    def scores() -> StreamingQuery:
        _make_folder(spark, f"{out}/changes")

        def write(batch: DataFrame, batch_id: int) -> None:
            sums_to_scores(batch, options).write.mode("overwrite").parquet(f"{out}/scores/batch_id={batch_id}")
        return run(target_sums(spark.readStream.schema(CHANGES).parquet(f"{out}/changes")), "scores", write)

    return LiveScores([evidence, changes, scores], available_now)


def start_dedup(findings: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """The changes that a stream of findings makes to the findings that stand, as a table at ``out``."""
    writer = dedup_stream(findings).writeStream.format("parquet").option("compression", "zstd").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return _with_rocks(findings.sparkSession, (writer.trigger(availableNow=True) if available_now else writer).start)


def read_live_scores(spark: SparkSession, out: str) -> DataFrame:
    """The last score of every target, with the columns of ``Engine.summary``; targets with a broken archive are left out."""
    rows = spark.read.parquet(f"{out}/scores")
    columns = [c for c in rows.columns if c not in ("target_id", "batch_id")]
    last = rows.groupBy("target_id").agg(F.max_by(F.struct(*columns), "batch_id").alias("last"))
    return last.filter("NOT last.broken").select("target_id", *[f"last.{c}" for c in columns if c != "broken"])


def read_live_findings(spark: SparkSession, out: str) -> DataFrame:
    """The findings of single files that stand now; those for want of a file are only in the scores."""
    return standing_findings(spark.read.schema(CHANGES).parquet(f"{out}/changes"))
