"""Scans of archives and requests as they arrive.

Each batch is taken apart by the batch plan. Nothing is kept between batches: no
state to grow, no watermark to choose. Outputs are written under the batch's
number, so a batch that is repeated after a failure replaces what its first try
wrote. Scores are not written by batch, as files of one target may come in
several: a batch leaves its evidence, and ``read_scores`` scores all there is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from argusframe.functions.urls import admit_archive, admit_url, canonical_repo
from argusframe.operators.sast import scan_sources
from argusframe.plans.evidence import read_evidence, write_evidence
from argusframe.plans.scan import Engine, ScanOptions
from argusframe.schema import FILES
from argusframe.sources.archives import unpack_archives

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"
FILES_PER_TRIGGER = 1000


def stream_archives(spark: SparkSession, path: str, kind: str = "zip", max_bytes: int | None = None) -> DataFrame:
    """``files`` of the archives that land in a folder. Broken ones, and those over the limit, are rows without a path."""
    glob, strip = ("*.zip", 0) if kind == "zip" else ("*.{tar.gz,tgz}", 1)
    archives = (
        spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True).option("maxFilesPerTrigger", FILES_PER_TRIGGER).load(path)
    )
    return unpack_archives(archives, kind, strip, max_bytes)


def stream_files(spark: SparkSession, path: str) -> DataFrame:
    """``files`` tables that land in a folder as Parquet."""
    return spark.readStream.schema(FILES).option("maxFilesPerTrigger", FILES_PER_TRIGGER).parquet(path)


def stream_scan(files: DataFrame) -> DataFrame:
    """Rule findings of a stream of files: the batch stage as it is, since it
    neither shuffles nor keeps state."""
    return scan_sources(files)


def _start(stream: DataFrame, write_batch, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def start_findings(files: DataFrame, out: str, checkpoint: str, options: ScanOptions | None = None,
                   available_now: bool = True) -> StreamingQuery:
    """All findings of each batch, below ``out/batch_id=N``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        engine = Engine(files=batch, options=options)
        engine.findings().write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        engine.close()
    return _start(files, write, checkpoint, available_now)


def start_scores(files: DataFrame, out: str, checkpoint: str, options: ScanOptions | None = None,
                 available_now: bool = True) -> StreamingQuery:
    """The evidence of each batch, below ``out/batch_id=N``; see ``read_scores``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        write_evidence(Engine(files=batch, options=options).plan_evidence(), f"{out}/batch_id={batch_id}")
    return _start(files, write, checkpoint, available_now)


def scored_stream(spark: SparkSession, out: str, options: ScanOptions | None = None) -> Engine:
    """An engine over everything ``start_scores`` has written so far, with the
    same options: its ``summary`` is that of one scan over all files, however
    they were spread over batches, and its ``errors`` has the broken archives."""
    return Engine(evidence=read_evidence(spark, out), options=options)


def read_scores(spark: SparkSession, out: str, options: ScanOptions | None = None) -> DataFrame:
    return scored_stream(spark, out, options).summary()


def stream_admission(requests: DataFrame) -> DataFrame:
    """``(request_id, kind, target, size)`` -> the same with ``admitted`` and
    ``reason``; ``kind`` is website, repo or archive. Stateless."""
    site, repo = admit_url(F.col("target")), canonical_repo(F.col("target"))
    archive = admit_archive(F.col("target"), F.col("size"))
    reason = (
        F.when(F.coalesce("target", F.lit("")) == "", "nothing to scan")
        .when(F.col("kind") == "website", site["reason"])
        .when(F.col("kind") == "repo", repo["reason"])
        .when(F.col("kind") == "archive", archive["reason"])
        .otherwise("unknown kind of request")
    )
    return requests.withColumn("reason", reason).withColumn("admitted", F.col("reason").isNull())


def start_admission(requests: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = (
        stream_admission(requests).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).outputMode("append")
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
