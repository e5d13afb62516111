"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app_name: str = "argusframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library is tuned for.

    Scans are narrow and text-heavy, so input splits are kept small enough that
    one split of decoded text fits a task; shuffles only carry findings.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.files.maxPartitionBytes": "64m",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A private temporary folder is only made for a local master (tests); on a
    cluster a folder one machine sees would be lost with that machine.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="argusframe-checkpoint-")
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from there, so that
    later stages see the same rows in the same partitions even if executors
    are lost."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files when it is written; else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(CLEAN_SHUFFLES)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)


def write_down(df: DataFrame) -> DataFrame:
    """``cut_lineage`` for wide or many rows: they are in columns and compressed, a small part of a checkpoint's bytes, and later stages
    read the columns they need. Rows keep neither their order nor their partitions. The folder stays in the checkpoint folder, unless
    ``forget`` removes it. What Parquet can't hold is cut off as ever."""
    if not _fits_parquet(df):
        return cut_lineage(df)
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/rows-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema(df.schema).parquet(path)
    rows._written = path
    return rows


def _fits_parquet(df: DataFrame) -> bool:
    kinds = df.schema.simpleString()
    return 0 < len(df.columns) == len({c.lower() for c in df.columns}) and not any(k in kinds for k in ("void", "interval", "struct<>"))


def forget(rows: DataFrame) -> None:
    """Remove what ``write_down`` wrote for ``rows``; nothing may read them, or what was made from them, after that."""
    path = getattr(rows, "_written", None)
    if path:
        remove_folder(rows.sparkSession, path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder this library wrote, on whatever file system it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
