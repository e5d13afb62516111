"""Counts, scores and grades per target; all decomposable sums, so a hot
target is summed up before it is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from argusframe.functions.severity import SEVERITIES, category_multiplier, severity_weight
from argusframe.operators.merge import EMISSION_ORDER
from argusframe.session import cut_lineage

# How the penalty shrinks and where grades and bands begin.
DIMINISH_STEP, DIMINISH_MAX = "0.01", "0.40"
GRADE_JSON = ((90, "A"), (80, "B"), (70, "C"), (60, "D"))
GRADE_REPORT = ((90, "A+"), (80, "A"), (70, "B"), (60, "C"), (50, "D"))
BAND_REPORT = ((80, "#22c55e"), (60, "#eab308"), (40, "#f97316"))
BAND_REPORT_ELSE = "#ef4444"
BAND_TERMINAL = ((80, "green"), (60, "yellow"))
BAND_TERMINAL_ELSE = "red"


def _steps(score: Column, steps, otherwise: str) -> Column:
    chain = F.when(score >= steps[0][0], steps[0][1])
    for bound, label in steps[1:]:
        chain = chain.when(score >= bound, label)
    return chain.otherwise(otherwise)


def grade_json(score: Column) -> Column:
    return _steps(score, GRADE_JSON, "F")


def grade_report(score: Column) -> Column:
    return _steps(score, GRADE_REPORT, "F")


def score_band(score: Column) -> Column:
    return _steps(score, BAND_REPORT, BAND_REPORT_ELSE)


def terminal_band(score: Column) -> Column:
    return _steps(score, BAND_TERMINAL, BAND_TERMINAL_ELSE)


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("target_id").agg(*_count_columns())


def _count_columns() -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]


def _penalty() -> Column:
    return F.coalesce(
        F.sum((severity_weight(F.col("severity")) * category_multiplier(F.col("category"))).cast("decimal(10,1)")),
        F.lit(0)).cast("decimal(20,1)")


def penalty(findings: DataFrame) -> DataFrame:
    return findings.groupBy("target_id").agg(_penalty().alias("penalty"))


def diminish(penalty_: Column, n: Column) -> Column:
    """Each finding takes a hundredth off the penalty, up to four tenths."""
    share = F.least(F.lit(DIMINISH_MAX).cast("decimal(3,2)"), (n.cast("decimal(20,0)") * F.lit(DIMINISH_STEP).cast("decimal(3,2)")).cast("decimal(24,2)"))
    factor = (F.lit("1.00").cast("decimal(3,2)") - share).cast("decimal(3,2)")
    return (penalty_.cast("decimal(20,1)") * factor).cast("decimal(25,3)")


def score_value(penalty_: Column, n: Column) -> Column:
    rounded = F.floor(F.lit(100).cast("decimal(3,0)") - diminish(penalty_, n) + F.lit("0.5").cast("decimal(2,1)"))
    return F.greatest(F.lit(0), rounded.cast("int")).cast("int")


def score_targets(findings: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """``(target_id, score, grade, report_grade, counts.., total)`` for every
    target; those without findings get 100."""
    sums = findings.groupBy("target_id").agg(
        *_count_columns(), F.count(F.lit(1)).alias("total"), _penalty().alias("penalty"))
    if targets is not None:
        sums = targets.select("target_id").join(sums, "target_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    score = score_value(F.coalesce("penalty", F.lit(0).cast("decimal(20,1)")), zero("total"))
    return sums.select("target_id", score.alias("score"), *[zero(s).alias(s) for s in SEVERITIES], zero("total").alias("total")).select(
        "target_id", "score", grade_json(F.col("score")).alias("grade"),
        grade_report(F.col("score")).alias("report_grade"), *SEVERITIES, "total")


def preview_findings(findings: DataFrame, first: int = 3) -> DataFrame:
    """First findings of each target in result order, with the number left out.
    The rank filter cuts each task's rows to ``first`` before the shuffle."""
    window = Window.partitionBy("target_id").orderBy(*EMISSION_ORDER)
    top = findings.withColumn("place", F.row_number().over(window)).filter(F.col("place") <= first)
    totals = findings.groupBy("target_id").agg(F.count(F.lit(1)).alias("_n"))
    return top.join(totals, "target_id").withColumn("remaining", F.greatest(F.col("_n") - first, F.lit(0))).drop("_n")


def findings_rollup(findings: DataFrame) -> DataFrame:
    """Counts by target, scanner and severity with all subtotals. Counted once
    at the finest grain, so that the levels are built from counts; those are written
    down, so that no task holds the table of one and of the other at once."""
    fine = cut_lineage(findings.groupBy("target_id", "scanner", "severity").agg(F.count(F.lit(1)).alias("n")))
    return fine.rollup("target_id", "scanner", "severity").agg(F.sum("n").alias("findings"))
