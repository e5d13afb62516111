"""Removal of passages that occur earlier in the corpus, by prefix-partitioned suffixes.

A suffix starts at every word; only its first ``WINDOW`` words matter, so its path
in the suffix tree is cut to two levels and a level is kept as the fingerprint of
the words down to it. Leaves of one deep node are suffixes with equal fingerprints
at depth ``WINDOW``; the tree is walked by sorting the suffixes of a group.

1. *Shallow prefixes.* Of the ``ANCHOR``-word prefixes inside a window the one with
   the least fingerprint stands for it, which equal windows agree on. About one
   word in seven is such an anchor. An anchor goes with a fingerprint of the stretch of
   words that the windows it stands for cover. Of equal stretches all but the first (doc_id, start)
   repeat as a whole. Anchors with a single kind of stretch need no more: their first one repeats nothing.
2. *Deep nodes.* Windows of the first stretch of each kind, where an anchor has several kinds, are grouped by
   two fingerprints of all their words, 96 bits together; in each group all but the first (doc_id, start) are repeats.
3. *Cut.* Words covered by a repeat go. Windows are judged on the input.

Both groupings are summed before the shuffle: of equal fingerprints in a batch
only the first is sent, the others are known to repeat and are sent to random
groups. A passage shared by a third of all documents so costs one row for each
batch, not for each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from argusframe.llm.common import store
from argusframe.llm.textbatch import Slice, as_long, fold, mix, slices, windows

WINDOW = 20
ANCHOR = 8
#: Bits of the number of a word in its text, and what makes a second fingerprint of a word.
WORD_BITS = 32
#: The low bits of a stretch's fingerprint: words from its start to its anchor, and how many windows follow its first one. Both are below 13.
SPAN_BITS = 4
STRETCH_BITS = 2 * SPAN_BITS
SECOND = np.uint64(0x5851F42D4C957F2D)
BROADCAST_IDS = 100_000


def _anchors(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows of a slice (word numbers), the anchor of each, the text of each, fingerprints of all anchors."""
    prefix = windows(s.words, ANCHOR)
    n = len(s.words) - WINDOW + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, prefix
    best = np.arange(len(prefix))
    for step in (1, 2, 4, WINDOW - ANCHOR + 1 - 8):
        a, b = best[:-step], best[step:]
        best = np.where(prefix[a] <= prefix[b], a, b)
    owner = np.repeat(np.arange(s.n), np.diff(s.word_bounds))
    starts = np.flatnonzero(owner[:n] == owner[WINDOW - 1:])
    return starts, best[starts], owner[starts], prefix


def _first_of_each(keys: np.ndarray, checks: np.ndarray, docs: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys to send and whether the row is already known to repeat.

    The first (doc, place) of equal keys and checks keeps its key. Rows at a later place are known and get a random key."""
    order = np.lexsort((places, docs, checks, keys))
    k, c = keys[order], checks[order]
    same = np.concatenate([[False], (k[1:] == k[:-1]) & (c[1:] == c[:-1])])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(k))))
    same &= (docs[order] != docs[order][head]) | (places[order] != places[order][head])
    out_keys, out_known = keys.copy(), np.zeros(len(keys), bool)
    out_known[order] = same
    moved = order[same]
    out_keys[moved] = mix(mix(docs[moved].astype(np.uint64)) + places[moved].astype(np.uint64))
    return out_keys, out_known


def _rows(keys: list, checks: list, docs: list, places: list) -> Iterator[pa.RecordBatch]:
    """``place`` holds the version of the document, the number of the word and, in its last bit, whether the row is known to repeat."""
    k, c, d, p = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, checks, docs, places))
    if len(k):
        k, known = _first_of_each(k, c, d, p)
        yield pa.RecordBatch.from_pydict({"key": as_long(k), "check": pa.array(c), "doc_id": pa.array(d), "place": pa.array(p.astype(np.int64) * 2 + known)})


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids and versions of the documents of a batch; a version stands above the word numbers of a place."""
    return tuple(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "version"))


def _whole_windows(words: np.ndarray) -> np.ndarray:
    """Fingerprint of the window at each word."""
    return fold(windows(words, WINDOW // 2), WINDOW // 2, WINDOW)


def _send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        (ids, versions), keys, checks, docs, places = _ids(batch), [], [], [], []
        for s in slices(batch.column("text")):
            starts, anchors, owner, prefix = _anchors(s)
            if not len(anchors):
                continue
            new = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
            first, last = starts[new], starts[np.concatenate([new[1:], [len(anchors)]]) - 1]
            anchors, owner = anchors[new], owner[new]
            whole = _whole_windows(s.words)
            # The first and the last window of a stretch hold all its words between them. The low bits say how the stretch lies around its anchor.
            stretch = mix(mix(whole[first]) + whole[last]) & ~np.uint64((1 << STRETCH_BITS) - 1)
            checks.append((stretch + (((anchors - first) << SPAN_BITS) + last - first).astype(np.uint64)).view(np.int64))
            keys.append(prefix[anchors])
            docs.append(ids[s.first + owner])
            places.append((versions[s.first + owner] << WORD_BITS) + anchors - s.word_bounds[owner])
        yield from _rows(keys, checks, docs, places)


def _send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        (ids, versions), hits, keys, checks, docs, places = _ids(batch), batch.column("hits"), [], [], [], []
        for s in slices(batch.column("text")):
            starts, anchors, owner, _ = _anchors(s)
            mine = hits.slice(s.first, s.n)
            words = np.repeat(s.word_bounds[:-1], mine.value_lengths().to_numpy(zero_copy_only=False)) + mine.flatten().to_numpy(zero_copy_only=False)
            hit = np.zeros(len(s.words) + 1, bool)
            hit[words] = True
            open_ = hit[anchors]
            starts, owner = starts[open_], owner[open_]
            for found, words in ((keys, s.words), (checks, mix(s.words ^ SECOND))):
                found.append(_whole_windows(words)[starts])
            checks[-1] = ((checks[-1] >> np.uint64(32)).astype(np.int64) - (1 << 31)).astype(np.int32)
            docs.append(ids[s.first + owner])
            places.append((versions[s.first + owner] << WORD_BITS) + starts - s.word_bounds[owner])
        yield from _rows(keys, checks, docs, places)


def _with_versions(docs: DataFrame) -> DataFrame:
    """(doc_id, version, text) of the rows that have an id. Rows alike in both are one version; different texts of one
    doc_id are numbered from 0 in the order of their hashes. Only ids with several texts are joined, which usually are few."""
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    several = texts.groupBy("doc_id").agg(F.min("h").alias("least"), F.max("h").alias("most")).filter("least <> most").select("doc_id")
    several = store(several, "several")
    few = several.count()
    if not few:
        return texts.select("doc_id", F.lit(0).cast("long").alias("version"), "text")
    ids = F.broadcast(several) if few <= BROADCAST_IDS else several
    distinct = texts.select("doc_id", "h").join(ids, "doc_id").distinct()
    versions = store(distinct.withColumn("version", (F.row_number().over(Window.partitionBy("doc_id").orderBy("h")) - 1).cast("long")), "versions")
    versions = F.broadcast(versions) if versions.count() <= BROADCAST_IDS else versions
    return texts.join(versions, ["doc_id", "h"], "left").select("doc_id", F.coalesce("version", F.lit(0).cast("long")).alias("version"), "text")


def repeated_windows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that hold a repeated anchor (doc_id, version, text, runs), and (doc_id, version, cuts) from single windows: ``runs`` and ``cuts`` are the windows
    that occur earlier, each number the start of the first in a row and, in the last ``SPAN_BITS``, how many follow it."""
    texts = _with_versions(docs)
    sent = "key bigint, check {}, doc_id bigint, place bigint"
    place, known = F.expr(f"CAST(shiftright(place, 1) & {(1 << WORD_BITS) - 1} AS INT)"), F.col("place").bitwiseAND(1) == 1
    document, order = ["doc_id", F.shiftright("place", WORD_BITS + 1).alias("version")], ["doc_id", F.shiftright("place", 1)]
    span = (1 << SPAN_BITS) - 1

    same = Window.partitionBy("key", "check").orderBy(*order)
    around = Window.partitionBy("key").orderBy("check", *order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kind = F.when(~known, F.col("check"))
    # Rows are dealt by key first; the ranks within a kind of stretch then need no shuffle of their own.
    anchors = texts.mapInArrow(_send_anchors, sent.format("bigint")).withColumn("least", F.min(kind).over(around)).withColumn("most", F.max(kind).over(around))
    anchors = anchors.withColumn("at", F.rank().over(same))
    again = known | (F.col("at") > 1)
    run = F.expr(f"shiftleft((shiftright(place, 1) & {(1 << WORD_BITS) - 1}) - (shiftright(check, {SPAN_BITS}) & {span}), {SPAN_BITS}) + (check & {span})")
    hits = anchors.filter(again | (F.col("least") != F.col("most"))).groupBy(*document).agg(
        F.collect_set(F.when(~again, place)).alias("hits"), F.collect_set(F.when(again, run)).alias("runs"))
    held = store(texts.join(hits, ["doc_id", "version"]), "held")

    leaves = held.filter("size(hits) > 0").mapInArrow(_send_windows, sent.format("int")).withColumn("at", F.rank().over(same))
    cuts = leaves.filter(known | (F.col("at") > 1)).groupBy(*document).agg(F.collect_set(F.shiftleft(place.cast("long"), SPAN_BITS)).alias("cuts"))
    return held.select("doc_id", "version", "text", "runs"), cuts


def _kept_words(texts: pa.Array, cuts: pa.Array | None) -> Iterator[tuple[int, int, bytes]]:
    """Number of words, number of removed words and kept words joined by one space, for each text; ``cuts`` as in ``repeated_windows``."""
    for s in slices(texts):
        gone = np.zeros(len(s.words) + 1, np.int64)
        if cuts is not None:
            mine = cuts.slice(s.first, s.n)
            lengths = pa.compute.fill_null(mine.value_lengths(), 0).to_numpy(zero_copy_only=False)
            runs = mine.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            words = np.repeat(s.word_bounds[:-1], lengths) + (runs >> SPAN_BITS)
            np.add.at(gone, words, 1)
            np.add.at(gone, np.minimum(words + (runs & ((1 << SPAN_BITS) - 1)) + WINDOW, len(s.words)), -1)
        keep = np.cumsum(gone[:-1]) == 0
        raw = s.data.tobytes()
        for a, b in zip(s.word_bounds[:-1], s.word_bounds[1:]):
            k = keep[a:b]
            if k.all():
                text = b" ".join(raw[s.bounds[s.text_of(s.starts[a:a + 1])[0]]:s.ends[b - 1]].split()) if b > a else b""
            else:
                text = b" ".join([raw[x:y] for x, y in zip(s.starts[a:b][k].tolist(), s.ends[a:b][k].tolist())])
            yield int(b - a), int((~k).sum()), text


def cut_documents(held: DataFrame, cuts: DataFrame) -> DataFrame:
    """(doc_id, h, n_removed, kept_text) of the documents that lose words, one row for each text; ``h`` is the hash of the text as it was."""

    def cut(batches):
        for batch in batches:
            found = list(_kept_words(batch.column("text"), batch.column("cuts")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2].decode() for x in found], pa.string())],
                                             names=["doc_id", "h", "n_removed", "kept_text"])

    both = held.join(cuts, ["doc_id", "version"], "left").withColumn("cuts", F.concat("runs", F.coalesce("cuts", F.array().cast("array<bigint>"))))
    joined = both.filter("size(cuts) > 0").withColumn("h", F.xxhash64("text"))
    return joined.mapInArrow(cut, "doc_id bigint, h bigint, n_removed bigint, kept_text string").dropDuplicates(["doc_id", "h"])


def word_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n_words, sha256): words of each whole text, joined by one space."""

    def digest(batches):
        for batch in batches:
            found = list(_kept_words(batch.column("text"), None))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array([x[0] for x in found], pa.int64()), pa.array([hashlib.sha256(x[2]).hexdigest() for x in found], pa.string())],
                                             names=["doc_id", "h", "n_words", "sha256"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    return keyed.mapInArrow(digest, "doc_id bigint, h bigint, n_words bigint, sha256 string")


def substring_dedup_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of ``docs``; see ``substring_dedup`` for odd rows."""
    held, cuts = repeated_windows(docs)
    changed = cut_documents(held, cuts).select("doc_id", "h", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept"))
    return word_digests(docs).join(changed, ["doc_id", "h"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept", "sha256").alias("kept_sha256"))


def substring_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated words taken out of ``text``; a text that loses none stays as it is.

    A null text stays null, a text of fewer than ``WINDOW`` words stays as it is. Of equal windows the first by (doc_id, start) stays. Rows alike in
    doc_id and text are one document and no copies of each other; different texts of one doc_id are documents of their own, in the
    order of their hashes; rows without doc_id are passed through; an empty table gives an empty result; other columns are kept as they are.
    """
    held, cuts = repeated_windows(docs)
    changed = cut_documents(held, cuts).select(F.col("doc_id").alias("__doc_id"), F.col("h").alias("__h"), F.col("kept_text").alias("__kept_text"))
    same = (F.col("doc_id").cast("long") == F.col("__doc_id")) & (F.xxhash64("text") == F.col("__h"))
    return docs.join(changed, same, "left").withColumn("text", F.coalesce("__kept_text", "text")).select(*docs.columns)
