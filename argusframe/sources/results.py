"""Earlier scan results, read back from their JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

FINDING_JSON = """struct<scanner:string,severity:string,category:string,title:string,description:string,file:string,line:int,
recommendation:string,ruleId:string,cve:string,installedVersion:string,fixedVersion:string>"""
RESULT_JSON = f"score int, grade string, findings array<{FINDING_JSON}>, scannedFiles bigint, duration double, scanType string"


def read_scan_results(results: DataFrame) -> DataFrame:
    """``(target_id, json)`` -> one row per readable result, absent fields
    filled."""
    rows = results.filter(F.try_parse_json("json").isNotNull()).select("target_id", F.from_json("json", RESULT_JSON).alias("r"))
    return rows.select(
        "target_id",
        F.coalesce("r.score", F.lit(0)).alias("score"),
        F.coalesce("r.grade", F.lit("F")).alias("grade"),
        F.coalesce("r.findings", F.expr(f"cast(array() as array<{FINDING_JSON}>)")).alias("findings"),
        F.coalesce("r.scannedFiles", F.lit(0)).alias("scanned_files"),
        F.coalesce("r.duration", F.lit(0.0)).alias("duration"),
        F.coalesce("r.scanType", F.lit("code")).alias("scan_type"),
    )


def read_json_results(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_json_results`` wrote, a row for each target and part."""
    lines = spark.read.text(path).select(F.from_json("value", "targetId string, part int").alias("id"), F.col("value").alias("json"))
    keyed = lines.select(F.to_json(F.struct(F.col("id.targetId").alias("t"), F.col("id.part").alias("p"))).alias("target_id"), "json")
    rows = read_scan_results(keyed).withColumn("id", F.from_json("target_id", "t string, p int"))
    return rows.select(F.col("id.t").alias("target_id"), F.col("id.p").alias("part"), "score", "grade", "findings", "scanned_files", "duration", "scan_type")


def scan_id(target_id, run: str):
    """Repeatable id of a scan: a retried job names it the same."""
    return F.sha2(F.concat_ws("|", target_id, F.lit(run)), 256)
