"""Scans that search only what is new.

Evidence is kept in a store by content: the hash of a text and its path. A later scan hashes its files, finds by an anti-join of the keys which of
them no scan has searched, searches these, adds them to the store, and takes the evidence of all its files from there. So a copy of a
file costs nothing in any target, and a scan of a tree in which one file in a hundred has changed searches that one.

The store has a folder for each set of rules, as other rules find other things.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from argusframe.operators.skew import salted_join
from argusframe.plans.evidence import EVIDENCE, file_evidence
from argusframe.plans.scan import Engine, ScanOptions
from argusframe.operators.rules import prune_rules
from argusframe.operators.secrets import SECRET_RULES
from argusframe.session import cut_lineage

KEY = ("path", "h1", "h2")
_STORED = "path string, h1 string, h2 bigint, size_bytes bigint, rule_ord int, line int, seq int, secret string, content string, kind string"
#: Keys of new files that are sent to every task, and beyond which they are joined.
BROADCAST_KEYS = 200_000


def rules_folder(options: ScanOptions) -> str:
    """A name for everything that decides what is found in a text."""
    rules = [(r.id, r.ord, r.scope, r.extensions, r.java, r.java_anti, r.needles) for r in (prune_rules(options.rules, options.min_severity) if options.sast else [])]
    secrets = [(r.id, r.ord, r.search, r.group, r.needles) for r in (prune_rules(SECRET_RULES, options.min_severity) if options.secrets else [])]
    return hashlib.sha256(repr((rules, secrets, options.max_bytes)).encode()).hexdigest()[:32]


@dataclass
class Rescan:
    """``engine`` continues from the evidence of all files; ``searched`` has (files, bytes) that this scan had to search."""

    engine: Engine
    searched: tuple[int, int]


def _with_key(files: DataFrame) -> DataFrame:
    """Two hashes, as a text that is taken for another would hide what is in it; a missing text is a key of its own."""
    return files.withColumn("h1", F.md5(F.coalesce("content", F.lit("")).cast("binary"))).withColumn("h2", F.xxhash64("content", "size_bytes"))


def rescan(files: DataFrame, store: str, options: ScanOptions | None = None) -> Rescan:
    """Scan ``files`` with a store of what earlier scans found, a folder that this function keeps.

    Files without a text (dependencies, folders that are not searched) have a key too. Rows without a path, which say
    that an archive is broken, are not kept: a repaired archive is read again."""
    spark, options = files.sparkSession, options or ScanOptions()
    folder = f"{store}/{rules_folder(options)}"
    keyed = _with_key(files.filter("path IS NOT NULL"))
    keys = cut_lineage(keyed.select("target_id", *KEY, "size_bytes"))
    known = _known(spark, folder)
    wanted = keys.select(*KEY, "size_bytes").dropDuplicates(list(KEY))
    new = cut_lineage(wanted if known is None else wanted.join(known.filter("kind = 'file'").select(*KEY), list(KEY), "left_anti"))
    totals = new.agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes")).first()
    if totals.files:
        chosen = F.broadcast(new.select(*KEY)) if totals.files <= BROADCAST_KEYS else new.select(*KEY)
        texts = keyed.join(chosen, list(KEY), "left_semi").dropDuplicates(list(KEY))
        # the key takes the place of the target while the text is searched
        rules = prune_rules(options.rules, options.min_severity) if options.sast else []
        secrets = prune_rules(SECRET_RULES, options.min_severity) if options.secrets else []
        named = texts.select(F.concat_ws(":", "h1", "h2").alias("target_id"), "path", "size_bytes", "content")
        found = file_evidence(named, rules, secrets, options.max_bytes)
        columns = [F.split("target_id", ":")[0].alias("h1"), F.split("target_id", ":")[1].cast("long").alias("h2")]
        found.select(*columns, *[c for c in found.columns if c != "target_id"]).write.partitionBy("kind").parquet(f"{folder}/scan={uuid.uuid4().hex}")
        known = _known(spark, folder)
    if known is None:
        evidence = spark.createDataFrame([], EVIDENCE)
    else:
        evidence = _evidence(keys, known)
    broken = file_evidence(files.filter("path IS NULL"), [], False, options.max_bytes)
    return Rescan(Engine(evidence=evidence.unionByName(broken), options=options), (totals.files, totals.bytes))


def _known(spark: SparkSession, folder: str) -> DataFrame | None:
    """Everything in the store; a scan that was killed while it wrote has left no marker and is not read."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/scan=*/_SUCCESS")
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    paths = sorted(str(x.getPath().getParent()) for x in found) if found is not None else []
    return spark.read.schema(_STORED).option("basePath", folder).parquet(*paths).dropDuplicates() if paths else None


def _evidence(keys: DataFrame, known: DataFrame) -> DataFrame:
    """The stored evidence under the targets of this scan. A file that a third of all targets hold meets few rows of the store, so the keys are salted."""
    rows = known.select(*KEY, *[c for c in _columns() if c not in ("target_id", "path", "size_bytes")])
    grouped = rows.groupBy(*KEY).agg(F.collect_list(F.struct(*[c for c in rows.columns if c not in KEY])).alias("items"))
    joined = salted_join(keys, grouped, list(KEY), "inner", salts=8)
    return joined.select("target_id", "path", "size_bytes", F.explode("items").alias("x")).select("target_id", "path", "size_bytes", "x.*").select(*_columns())


def _columns() -> list[str]:
    return [c.split()[0] for c in EVIDENCE.split(", ")]
