"""Fixed table schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

FILES = T.StructType([
    T.StructField("target_id", T.StringType(), False),
    T.StructField("path", T.StringType(), False),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("content", T.StringType()),
])

RESPONSES = T.StructType([
    T.StructField("target_id", T.StringType(), False),
    T.StructField("url", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("kind", T.StringType(), False),
    T.StructField("method", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("headers", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    T.StructField("body", T.StringType()),
])

FINDINGS = T.StructType([
    T.StructField("target_id", T.StringType()),
    T.StructField("scanner", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("recommendation", T.StringType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("cve", T.StringType()),
    T.StructField("installed_version", T.StringType()),
    T.StructField("fixed_version", T.StringType()),
    T.StructField("scanner_ord", T.IntegerType()),
    T.StructField("rule_ord", T.IntegerType()),
    T.StructField("seq", T.IntegerType()),
])

FINDING_COLUMNS = FINDINGS.fieldNames()

# Place of each scanner in a result: secrets, then dependencies, then code;
# an external code report comes before the built-in rules it is merged with.
SCANNER_ORD = {"secrets": 1, "trivy": 2, "npm-audit": 2, "deps": 2, "semgrep": 3, "sast": 4, "web": 5}


def as_findings(df: DataFrame) -> DataFrame:
    """Cast to the findings schema; columns that are absent become null."""
    have = set(df.columns)
    return df.selectExpr(*[
        f"cast({f.name if f.name in have else 'NULL'} AS {f.dataType.simpleString()}) AS {f.name}" for f in FINDINGS.fields])
