"""Tables of files and captured exchanges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from argusframe.schema import FILES, RESPONSES

_FORMATS = ("parquet", "json", "orc")


def read_files(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A ``files`` table. Directory listings of text files are no source here:
    Spark hides names that begin with a dot or an underscore."""
    return _load(spark, path, fmt, FILES)


def read_responses(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return lower_header_names(_load(spark, path, fmt, RESPONSES))


def lower_header_names(responses: DataFrame) -> DataFrame:
    """Header names are matched whatever their case. Values of names that
    differ in case only are put together."""
    entries = F.map_entries("headers")
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    merged = F.map_from_entries(F.transform(names, lambda n: F.struct(
        n.alias("key"),
        F.flatten(F.transform(F.filter(entries, lambda e: F.lower(e["key"]) == n), lambda e: e["value"])).alias("value"))))
    plain = F.transform_keys("headers", lambda k, _: F.lower(k))
    unique = F.size(names) == F.size("headers")
    return responses.withColumn("headers", F.when(unique, plain).otherwise(merged))


def _load(spark: SparkSession, path: str, fmt: str, schema) -> DataFrame:
    if fmt not in _FORMATS:
        raise ValueError(f"unknown format {fmt!r}; one of {', '.join(_FORMATS)}")
    return spark.read.schema(schema).format(fmt).load(path)
