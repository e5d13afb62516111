"""Spelling variants: words that differ by one code point, grouped under their most frequent form.

Two words are one edit apart if the lengths of their common prefix and common suffix together reach the longer length L
less one. So at least one of the two covers L // 2 code points, and words meet only where that half is equal: each word is
dealt by its first and by its last half, for L its own length and one more. In such a group words stand as rows of padded
code-point matrices, one aligned left and one right, and blocks of rows are compared pair by pair (a tile), which gives the prefix and
suffix lengths of all their pairs at once. A large group has many blocks, and each pair of blocks is a tile of its own for
any task; only pairs that are one edit apart leave the tile.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argusframe.llm.common import shuffle_width, store
from argusframe.operators.skew import salted_join

# Letters of a run, and which code points the corpus is known to have lost.
LETTERS = r"[A-Za-zÀ-ÿ]"
LOST = 97
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class SpellingParams:
    """``min_length`` code points and ``min_count`` occurrences make a word; a form has ``ratio`` times the occurrences; ``tile_bytes``: padded
    code points of a block; ``pair_bytes``: code points compared at once."""

    min_length: int = 5
    min_count: int = 3
    ratio: int = 2
    tile_bytes: int = 1 << 16
    pair_bytes: int = 1 << 23


def _shortened(run: str) -> str:
    """SQL for a lower-cased run without the code point that its hash with the doc_id drops, if any."""
    h = f"crc32(encode(concat(coalesce(CAST(doc_id AS STRING), ''), ':', {run}), 'UTF-8'))"
    at = f"CAST({h} % char_length({run}) AS INT)"
    return f"IF({h} % {LOST} = 0, concat(left({run}, {at}), substring({run}, {at} + 2)), {run})"


def vocabulary(docs: DataFrame, params: SpellingParams) -> DataFrame:
    """(word, n) of all words with enough occurrences in the whole texts."""
    runs = docs.select("doc_id", F.explode(F.expr(f"regexp_extract_all(text, r'{LETTERS}{{{params.min_length},}}', 0)")).alias("run"))
    lowered = runs.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    words = lowered.select(F.expr(_shortened("run")).alias("word")).filter(F.char_length("word") >= params.min_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= params.min_count)


def _halves(words: DataFrame) -> DataFrame:
    """(word, n, wide, side, half, short): the groups of each word, by the longer length of a pair and by prefix or suffix.

    ``half`` is a hash of the half: words that share it by chance are compared in vain, no more.
    """
    length = F.char_length("word")
    out = words.select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("short")).withColumn("wide", length + F.col("short"))
    half = F.floor(F.col("wide") / 2).cast("int")
    sides = F.array(F.struct(F.lit(0).alias("side"), F.xxhash64(F.left("word", half)).alias("half")),
                    F.struct(F.lit(1).alias("side"), F.xxhash64(F.right("word", half)).alias("half")))
    return out.select("word", "n", "wide", "short", F.explode(sides).alias("x")).select("word", "n", "wide", "x.side", "x.half", "short")


def _tiles(words: DataFrame, params: SpellingParams) -> DataFrame:
    """(wide, side, half, i, j, part, short, word, n): each word in every tile of its group; part 0 is of block i, part 1 of block j."""
    group = ["wide", "side", "half"]
    members = _halves(words)
    sizes = members.groupBy(*group).agg(F.count("*").alias("members"), F.min("short").alias("least")).filter("members > 1 AND least = 0")
    blocks = F.least(F.col("members"), F.ceil(F.col("members") * F.greatest("wide", F.lit(16)) / params.tile_bytes))
    dealt = salted_join(members, sizes.select(*group, blocks.cast("int").alias("blocks")), group, salts=4)
    own = dealt.withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    other = own.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return other.select(*group, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("part"), "short", "word", "n")


def one_edit(left: np.ndarray, right: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common prefix lengths of rows a and b, and which of these pairs are one edit apart.

    ``left`` and ``right`` are padded matrices, aligned left and right; the pad is in no word, so the first difference is
    the prefix, and no prefix or suffix counts beyond the shorter word.
    """
    differs = left[a] != left[b]
    prefix = np.where(differs.any(1), differs.argmax(1), left.shape[1])
    differs = right[a][:, ::-1] != right[b][:, ::-1]
    suffix = np.where(differs.any(1), differs.argmax(1), right.shape[1])
    shorter, longer = np.minimum(lengths[a], lengths[b]), np.maximum(lengths[a], lengths[b])
    prefix, suffix = np.minimum(prefix, shorter), np.minimum(suffix, shorter)
    return prefix, (prefix + suffix >= longer - 1) & (differs.any(1) | (lengths[a] != lengths[b])) & (longer - shorter <= 1)


def padded(words: list[str], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matrices of code points plus one, aligned left and right, with zeros beside; in bytes where they fit."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    kind = np.uint8 if not len(points) or points.max() < 255 else np.uint32
    width = int(lengths.max(initial=1))
    rows = np.repeat(np.arange(len(words)), lengths)
    places = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    left, right = np.zeros((len(words), width), kind), np.zeros((len(words), width), kind)
    left[rows, places] = points + 1
    right[rows, places + np.repeat(width - lengths, lengths)] = points + 1
    return left, right


def _first_of(change: np.ndarray) -> np.ndarray:
    """For each row the row in which its run starts; ``change`` marks the first rows."""
    return np.maximum.accumulate(np.where(change, np.arange(len(change)), 0))


def _compare(table: pa.Table, pair_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row numbers of ``table`` that are one edit apart; the rows of a tile stand together, by part and then longer ones first."""
    key = [np.asarray(table[c]) for c in ("wide", "side", "half", "i", "j")]
    part, short = np.asarray(table["part"]), np.asarray(table["short"])
    n = len(part)
    change = np.zeros(n, bool)
    change[0] = True
    for x in key:
        change[1:] |= x[1:] != x[:-1]
    start = _first_of(change)
    heads = np.flatnonzero(change)
    tile = np.cumsum(change) - 1
    end = np.append(heads[1:], n)[tile]
    count = lambda mask: np.bincount(tile, weights=mask, minlength=len(heads)).astype(np.int64)[tile]
    first_part, long_second = count(part == 0), count((part == 1) & (short == 0))
    long_first = count((part == 0) & (short == 0))
    row = np.arange(n)
    across = key[3] != key[4]
    # Two words of the lesser length are paired in the group of that length, not here.
    low = np.where(across, start + first_part, row + 1)
    high = np.where(across, np.where(part == 1, low, np.where(short == 1, low + long_second, end)), np.where(short == 1, row + 1, end))
    partners = np.where(across | (row < start + long_first), np.maximum(0, high - low), 0)

    words = table["word"].to_pylist()
    lengths = np.fromiter(map(len, words), np.int64, n)
    left, right = padded(words, lengths)
    most = max(1, pair_bytes // (left.shape[1] * left.itemsize))
    before = np.concatenate([[0], np.cumsum(partners)])
    for at in range(0, int(before[-1]), most):
        to = min(at + most, int(before[-1]))
        number = np.arange(at, to)
        a = np.searchsorted(before, number, side="right") - 1
        b = low[a] + number - before[a]
        prefix, near = one_edit(left, right, lengths, a, b)
        half = key[0][a] // 2
        near &= np.where(key[1][a] == 0, prefix >= half, prefix < half)
        yield a[near], b[near]


LINKS = "word string, n long, near string, near_n long"
CHUNK_ROWS = 1 << 15
CHUNK_BYTES = 1 << 24


def _tile_links(pair_bytes: int):
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])
    tile = ("wide", "side", "half", "i", "j")

    def links(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for a, b in _compare(table, pair_bytes):
            if len(a):
                one, two = table.select(["word", "n"]).take(a), table.select(["word", "n"]).take(b)
                both = pa.table([pa.chunked_array(one["word"].chunks + two["word"].chunks), pa.chunked_array(one["n"].chunks + two["n"].chunks),
                                 pa.chunked_array(two["word"].chunks + one["word"].chunks), pa.chunked_array(two["n"].chunks + one["n"].chunks)], schema=schema)
                yield from both.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = size = 0
        for batch in batches:
            held.append(batch)
            rows, size = rows + len(batch), size + batch.nbytes
            if rows < CHUNK_ROWS and size < CHUNK_BYTES:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            # The last tile may go on in the next batch.
            last = np.ones(len(table), bool)
            for c in tile:
                x = np.asarray(table[c])
                last &= x == x[-1]
            whole = len(table) - int(last.sum())
            if whole:
                yield from links(table.slice(0, whole))
            rest = table.slice(whole)
            held, rows, size = rest.to_batches(), len(rest), rest.nbytes
        if rows:
            yield from links(pa.Table.from_batches(held).combine_chunks())

    return run


def near_words(words: DataFrame, params: SpellingParams) -> DataFrame:
    """(word, n, near, near_n): each pair of words of (word, n) that are one edit apart, both ways."""
    tile = ["wide", "side", "half", "i", "j"]
    dealt = _tiles(words, params).repartition(shuffle_width(words.sparkSession), *tile).sortWithinPartitions(*tile, "part", "short")
    return dealt.mapInArrow(_tile_links(params.pair_bytes), LINKS)


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms are followed to the last by pointer jumping; a form is more frequent than its word, so chains end."""
    up = store(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "forms")
    while True:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = store(salted_join(up, further, ["root"], "left", salts=4).select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        up = after.select("word", "root")
        if after.filter("moved").limit(1).count() == 0:
            return up


def spelling_groups(docs: DataFrame, params: SpellingParams | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of the column ``text`` of ``docs``.

    A null text has no runs and a null doc_id counts as an empty one; repeated rows count each; equal occurrences are decided by code-point
    order; a table without words gives an empty result; only doc_id and text are read, so other columns may have any name.
    """
    p = params or SpellingParams()
    words = store(vocabulary(docs.select("doc_id", "text"), p), "words")
    best = near_words(words, p).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    forms = words.join(best, "word", "left").withColumn("form_n", F.when(-F.col("best.m") >= p.ratio * F.col("n"), -F.col("best.m")))
    forms = store(forms.select("word", F.when(F.col("form_n").isNotNull(), F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n"), "near")
    return forms.join(_roots(forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
