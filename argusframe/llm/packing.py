"""Best-fit decreasing packing of tokenized documents into sequences of fixed length.

Best fit looks only at lengths, and there are at most ``capacity`` of them. So the plan is made from the counts of
lengths: sequences with the same room left are kept as runs of numbers, a segment tree over the room left finds
the tightest run that still fits in logarithmic time, and a whole run is filled in one step. The plan has the
size of the capacity, not of the corpus, and gives the same sequences as placing the pieces one by one from the
longest to the shortest. Pieces then find their place by their rank among the pieces of their length, which is
counted in buckets (no length is gathered in one task).
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from argusframe.llm.common import shuffle_width, store

CAPACITY = 2048
END_ID = 0
# Fixed value: the pre-tokenization pattern of the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class TokenEncoder:
    """Ids of texts for a byte-level BPE file of the tokenizers library.

    Words after a space or a line break are encoded once and kept (``limit`` bounds the cache). Texts with other
    white space between words are encoded whole, and those that spell a special token by the library itself.
    """

    def __init__(self, path: str, limit: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.limit, self.cache = path, limit, {}
        self.special = [x["content"] for x in spec["added_tokens"]]
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in printed]
        byte_of = {chr(b): b for b in printed} | {chr(256 + k): b for k, b in enumerate(hidden)}
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in self.special}
        self.plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _ids(self, text: str) -> bytes:
        return np.array(self.plain.encode_ordinary(text), "<u4").tobytes()

    def _word(self, word: str) -> bytes | None:
        inner = word[1:] if word[:1] == "\n" else word
        if not inner or inner[0].isspace() or inner[-1].isspace():
            return None
        return self._ids(word if word[0] == "\n" else " " + word)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if any(s in text for s in self.special):
            return np.array(_library(self.path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = text.replace("\n", " \n").split(" ")
        cache, head = self.cache, words[0]
        if not head or head[0].isspace() or head[-1].isspace():
            return self._ids(text)
        out = [self._ids(head)]
        for word in words[1:]:
            ids = cache.get(word)
            if ids is None:
                if len(cache) >= self.limit:
                    cache.clear()
                ids = self._word(word)
                if ids is None:
                    return self._ids(text)
                cache[word] = ids
            out.append(ids)
        return b"".join(out)


@lru_cache(maxsize=2)
def _library(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def encoder(path: str) -> TokenEncoder:
    """One encoder for each file in a Python worker."""
    return TokenEncoder(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): documents with their end id, those longer than ``capacity`` cut into
    pieces of that length after a first one with the rest."""

    def cut(batches):
        enc, end = encoder(path), int(END_ID).to_bytes(4, "little")
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = enc.encode(text.as_py() or "") + end
                n = len(ids) // 4
                bounds = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    part = ids[4 * a:4 * b]
                    for column, value in zip(rows, (doc, k, a, b - a, zlib.crc32(part), part)):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
            keep = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows[:keep], types)], names=names[:keep])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids binary" if with_ids else ""))


class RoomTree:
    """Segment tree over the room left: which amounts some open sequence has."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.some = np.zeros(2 * self.leaves, bool)

    def set(self, room: int, some: bool) -> None:
        k = room + self.leaves
        self.some[k] = some
        while k > 1:
            k //= 2
            self.some[k] = self.some[2 * k] or self.some[2 * k + 1]

    def tightest(self, need: int) -> int:
        """Least room that is at least ``need``; -1 if there is none."""
        k = need + self.leaves
        if self.some[k]:
            return need
        while k > 1:
            if k % 2 == 0 and self.some[k + 1]:
                k += 1
                while k < self.leaves:
                    k = 2 * k if self.some[2 * k] else 2 * k + 1
                return k - self.leaves
            k //= 2
        return -1


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Where the pieces of each length go: rows of (length, first rank, first sequence, offset), by length and rank.

    From a row on, ranks and sequences go up together until the next row of the length. Pieces of one length that meet in a sequence fill it one after the other."""
    tree, runs, plan, opened = RoomTree(capacity), {}, [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            at = runs.setdefault(room, deque())
            if at and at[-1][0] + at[-1][1] == first:
                at[-1] = (at[-1][0], at[-1][1] + n)
            else:
                at.append((first, n))
            if len(at) == 1:
                tree.set(room, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]

        def fill(first: int, n: int, room: int, each: int) -> None:
            nonlocal rank
            for k in range(each):
                plan.append((length, rank, first, capacity - room + k * length))
                rank += n
            put(room - each * length, first, n)

        while left:
            room = tree.tightest(length)
            if room < 0:
                each = capacity // length
                first, n = opened, max(1, left // each)
                opened += n
            else:
                first, n = runs[room].popleft()
                if not runs[room]:
                    tree.set(room, False)
                each = room // length
            room = capacity if room < 0 else room
            full = min(n, left // each)
            if full:
                fill(first, full, room, each)
                left -= full * each
            if full < n:
                rest = 1 if left else 0
                if n - full - rest:
                    runs.setdefault(room, deque()).appendleft((first + full + rest, n - full - rest))
                    tree.set(room, True)
                if rest:
                    fill(first + full, 1, room, left)
                    left = 0
    return np.array(plan, np.int64).reshape(-1, 4)


def place(pieces_: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces_`` with sequence_id and offset. It is read twice and should be stored."""
    counts = {r.length: r.n for r in pieces_.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    plan = best_fit_plan(counts, capacity)
    keys = (plan[:, 0] << 44) + plan[:, 1]
    order = np.argsort(keys)
    keys, plan = keys[order], plan[order]

    buckets = 2 * shuffle_width(pieces_.sparkSession)
    keyed = pieces_.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    heads = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn(
        "head", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    ranked = keyed.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece"))).join(heads, ["length", "bucket"])
    ranked = ranked.select(*pieces_.columns, (F.col("rank") - 1 + F.col("head")).alias("rank"))

    def look_up(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(plan[at, 2] + rank - plan[at, 1]), pa.array(plan[at, 3])], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces_.schema.fields)
    return ranked.mapInArrow(look_up, f"{schema}, sequence_id bigint, offset bigint")


def best_fit_packing(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) for each piece of each row of ``docs``.

    A null or empty text is one piece with the end id alone; repeated rows are packed each; pieces of equal length may change places without
    changing the number of sequences; an empty table gives an empty result; only doc_id and text are read.
    """
    return place(store(pieces(docs, path, capacity, with_ids), "pieces"), capacity)
