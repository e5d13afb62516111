"""Labelled documents for fitting a classifier: all of them, or bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_of(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % folds


def _agreed(labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """(doc_id, label) outside the held-out fold; ids with conflicting labels are left out."""
    sides = labels.filter(F.col(label).isin(0, 1) & (fold_of("doc_id", folds) != held_out)).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("other"))
    return sides.filter("label = other").select("doc_id", "label")


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """(doc_id, text, lang, label) of every row with a label 0 or 1 outside the held-out fold; ids with conflicting labels are left out.

    Labels grow with the documents, so they are never broadcast; rows of the held-out fold and ids without a row are gone before the shuffle of the texts."""
    rows = docs.select("doc_id", "text", "lang").filter(fold_of(F.col("doc_id").cast("long"), folds) != held_out)
    return rows.join(_agreed(labels, label, folds, held_out).hint("merge"), "doc_id")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_label: int, max_bytes: int) -> list[tuple[str, str, int]]:
    """At most ``per_label`` (text, lang, label) of each label 0 and 1, outside the held-out fold, the same at every call.

    Ids with conflicting labels are left out, and so are texts longer than ``max_bytes``, both before the draw, which goes by the hash of the id. So at most
    ``2 * per_label`` ids are drawn; rows that repeat an id come with it. Without such texts the sample is empty, and the caller says what it does then.
    """
    short = docs.filter(F.octet_length(F.coalesce("text", F.lit(""))) <= max_bytes)
    known = _agreed(labels, label, folds, held_out).join(short.select("doc_id"), "doc_id", "left_semi")
    order = F.xxhash64(F.col("doc_id").cast("long"), F.lit(label))
    drawn = [known.filter(F.col("label") == y).orderBy(order, "doc_id").limit(per_label) for y in (0, 1)]
    both = drawn[0].unionByName(drawn[1])
    rows = short.join(F.broadcast(both), "doc_id").select("doc_id", "text", "lang", "label").collect()
    rows.sort(key=lambda r: (r.doc_id, r.text or ""))
    return [(r.text or "", r.lang or "", r.label) for r in rows]
