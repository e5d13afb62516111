"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Sources share a budget of words by weight; a source gives at most ``most`` times its words, and what is over goes to the others by
weight until none is above. All documents of a source expect the same number of copies, target by size. Within the source, in the order
of their sizes, the prefix sum of these expectations plus one random offset runs up a ruler, and a document is
emitted once for each whole number that its step crosses. So each stretch of like sizes is
hit evenly, which keeps the words taken within about the longest document of the target, and no document has more than ``most`` copies.

Prefix sums are rank times expectation. Ranks come from range partitions, so a source that holds a third of all rows is spread over
many tasks. Of a source only one row is ever gathered; the level to which sources are filled is found from sums.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argusframe.llm.common import store
from argusframe.operators.skew import number_rows

WORD = r"[^\x20\x09-\x0D]+"
OFFSET_DIGITS = 13


@dataclass(frozen=True)
class MixParams:
    """``weights`` are dealt to the sources by code point, repeating; the mix has ``share`` times all words; ``seed`` sets the offsets."""

    weights: tuple[float, ...] = (3, 1, 2)
    share: float = 1.5
    most: int = 2
    seed: int = 12


def _random(params: MixParams, name: Column) -> Column:
    """A number from 0 to below 1 that seed and name decide."""
    digest = F.md5(F.concat(F.lit(f"{params.seed}:"), F.coalesce(name.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.left(digest, F.lit(OFFSET_DIGITS)), 16, 10).cast("double") / F.lit(float(16 ** OFFSET_DIGITS))


def source_targets(sizes: DataFrame, params: MixParams | None = None) -> DataFrame:
    """(source, source_size, weight, target) of a table (source, size); a missing source is one of its own and comes last."""
    p = params or MixParams()
    sums = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    numbered = number_rows(sums.withColumn("all", F.lit(0)), "all", [F.col("source").isNull(), "source"])
    cycle = F.array(*[F.lit(float(w)) for w in p.weights])
    sources = store(numbered.select("source", "source_size", F.element_at(cycle, (F.pmod(F.col("n") - 1, F.lit(len(p.weights))) + 1).cast("int")).alias("weight")), "sources")
    cap = F.col("source_size") * float(p.most)
    words = sources.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while words:
        over = cap < F.col("weight") * F.lit(level)
        now = sources.agg(F.count_if(over).alias("full"), F.sum(F.when(over, cap)).alias("given"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if now.full == full or not now.weight:
            break
        level, full = (p.share * words - (now.given or 0.0)) / now.weight, now.full
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def sampled(docs: DataFrame, keep: Column, params: MixParams | None = None) -> DataFrame:
    """(keep, size, source_size, target, copies) for each row of ``docs``, read by its columns doc_id, text and source."""
    p = params or MixParams()
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    tie = F.md5(F.concat(F.lit(f"{p.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = store(docs.select(keep.alias("keep"), "source", size.alias("size"), tie.alias("tie"), F.xxhash64("doc_id", "text").alias("version"),
                             F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("stratum")), "sized")
    targets = source_targets(rows.select("source", "size"), p)
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    strata = store(targets.select(F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("stratum"), "source_size", "target",
                                  expected.alias("expected"), _random(p, F.col("source")).alias("start")), "targets")
    ranked = number_rows(rows.drop("source"), "stratum", ["size", "tie", "version"], number="rank", per_group=strata)
    crossed = F.floor(F.col("rank") * F.col("expected") + F.col("start")) - F.floor((F.col("rank") - 1) * F.col("expected") + F.col("start"))
    return ranked.select("keep", "size", "source_size", "target", F.least(crossed, F.lit(p.most)).alias("copies"))


def mix_sources(docs: DataFrame, params: MixParams | None = None) -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as it is taken, with all its columns.

    Null texts and texts without words have no words, and are taken at the rate of their source; a null source is a source; repeated rows are taken each on
    its own; an empty table gives an empty mix; columns other than doc_id, text and source may have any name.
    """
    out = sampled(docs, F.struct(*docs.columns), params)
    return out.filter("copies > 0").select(F.explode(F.array_repeat("keep", F.col("copies").cast("int"))).alias("keep")).select("keep.*")


def mix_counts(docs: DataFrame, params: MixParams | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of ``docs``, with the rules of ``mix_sources``."""
    out = sampled(docs, F.col("doc_id"), params)
    return out.select(F.col("keep").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
