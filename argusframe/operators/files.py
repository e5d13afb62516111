"""File-level filters and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from argusframe.functions.text import base_name, path_extension

# Names never scanned, names never counted, extensions counted.
SCAN_IGNORED = (
    "node_modules", ".git", "dist", "build", ".next", "__pycache__",
    "venv", ".venv", "vendor", ".cache", "coverage", ".nyc_output",
    "test", "tests", "__tests__", "__mocks__", "fixtures", "test-fixtures",
    "spec", "e2e", "cypress", "playwright",
)
COUNT_IGNORED = (
    "node_modules", ".git", "dist", "build", ".next", "__pycache__",
    "venv", ".venv", "vendor", ".cache", "coverage",
    "test", "tests", "__tests__", "__mocks__", "fixtures",
)
COUNT_EXTENSIONS = (
    ".js", ".ts", ".jsx", ".tsx", ".py", ".go", ".rb", ".java",
    ".env", ".yaml", ".yml", ".json", ".toml", ".cfg", ".conf",
    ".properties", ".sh", ".sql", ".tf",
)
MAX_DEPTH = 10
MAX_SCAN_BYTES = 1024 * 1024


def _reachable(path: Column, kept_hidden, ignored: tuple[str, ...], depth: int | None = MAX_DEPTH) -> Column:
    names = F.split(path, "/")
    blocked = F.exists(names, lambda n: (F.startswith(n, F.lit(".")) & ~kept_hidden(n)) | n.isin(*ignored))
    return ~blocked if depth is None else (F.size(names) <= depth) & ~blocked


def is_scanned_path(path: Column) -> Column:
    return _reachable(path, lambda n: n == ".gitignore", SCAN_IGNORED)


def is_counted_path(path: Column) -> Column:
    walked = _reachable(path, lambda n: F.startswith(n, F.lit(".env")), COUNT_IGNORED)
    return walked & (path_extension(path).isin(*COUNT_EXTENSIONS) | F.startswith(base_name(path), F.lit(".env")))


def is_secret_path(path: Column) -> Column:
    """Files searched for secrets: as counted, but of any extension and depth."""
    return _reachable(path, lambda n: F.startswith(n, F.lit(".env")), COUNT_IGNORED, depth=None)


def prune_paths(files: DataFrame) -> DataFrame:
    return files.filter(is_scanned_path(F.col("path")))


def size_cap(files: DataFrame, max_bytes: int = MAX_SCAN_BYTES) -> DataFrame:
    return files.filter(F.col("size_bytes") <= max_bytes)


def count_files(files: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Counted files per target; targets without any get 0."""
    counts = (
        files.filter(is_counted_path(F.col("path")))
        .groupBy("target_id").agg(F.count(F.lit(1)).alias("scanned_files"))
    )
    if targets is None:
        return counts
    return (
        targets.select("target_id").join(counts, "target_id", "left")
        .select("target_id", F.coalesce("scanned_files", F.lit(0)).cast("bigint").alias("scanned_files"))
    )


def explode_lines(files: DataFrame) -> DataFrame:
    """One row per line, numbered from 1; text after a last newline is a line."""
    return files.select(
        "target_id", "path", F.posexplode(F.split("content", "\n")).alias("pos", "text")
    ).select("target_id", "path", (F.col("pos") + 1).alias("line"), "text")
