"""Ranked lexical search of many items at once, with the work that items share done once.

Items whose texts have terms in common have sums in common. The term sets that items share are mined greedily: the pair of terms that
most items hold becomes a node, takes the place of the pair in these items, and may be paired again. So the items become a
directed graph: leaves are terms, inner nodes are shared sets, and an item is the sum of the few nodes that are left of it.

Documents are read once. A document leaves its number of terms and its counts of the items' terms (postings), which also give the
statistics over all documents. In the second pass the accumulators of a slice of documents are rows of a matrix: one for
each leaf from the postings, one for each inner node from its two children, each made once and used by all items that need it. A task keeps the best
documents of each item and gives them out at its end, so that what is shuffled doesn't grow with the documents of a task.

Items of any number are searched in passes of ``pass_terms`` terms; only the terms of a pass are at the driver and in the tasks.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from argusframe.llm.common import store
from argusframe.llm.textbatch import Slice, slices

# Bytes that stand between terms, and the pattern that says the same of code points.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
APART = np.zeros(256, bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    APART[_low:_high + 1] = True
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORT = 64
NO_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class SearchParams:
    """``top`` documents of each item; ``plan_items`` items share a plan; ``mined`` most shared terms of an item are mined, the others are
    added one by one; ``matrix_bytes`` of accumulators are held at once."""

    top: int = 20
    plan_items: int = 256
    mined: int = 256
    pass_terms: int = 200_000
    matrix_bytes: int = 1 << 24


@dataclass
class Plan:
    """Accumulators of some items: one for each of ``terms``, then ``scaled`` (leaf, times), then ``sums`` (two earlier ones); ``roots``: those that make up each item."""

    items: list[int]
    terms: list[int] = field(default_factory=list)
    scaled: list[tuple[int, int]] = field(default_factory=list)
    sums: list[tuple[int, int]] = field(default_factory=list)
    roots: list[list[int]] = field(default_factory=list)

    @property
    def size(self) -> int:
        return len(self.terms) + len(self.scaled) + len(self.sums)


def share(items: dict[int, Counter], mined: int) -> Plan:
    """The plan of items, given as the number of times each term occurs in them."""
    plan = Plan(sorted(items))
    plan.terms = sorted({t for counts in items.values() for t in counts})
    at = {t: k for k, t in enumerate(plan.terms)}
    plan.scaled = sorted({(at[t], q) for counts in items.values() for t, q in counts.items() if q > 1})
    times = {x: len(plan.terms) + k for k, x in enumerate(plan.scaled)}
    left = [{at[t] if q == 1 else times[at[t], q] for t, q in items[k].items()} for k in plan.items]

    holders: dict[int, set[int]] = defaultdict(set)
    for k, symbols in enumerate(left):
        for s in symbols:
            holders[s].add(k)
    pairs: Counter = Counter()
    for symbols in left:
        common = sorted((s for s in symbols if len(holders[s]) > 1), key=lambda s: (-len(holders[s]), s))[:mined]
        pairs.update(combinations(sorted(common), 2))
    heap = [(-n, a, b) for (a, b), n in pairs.items() if n > 1]
    heapq.heapify(heap)
    while heap:
        n, a, b = heapq.heappop(heap)
        both = holders[a] & holders[b]
        if len(both) < 2:
            continue
        if len(both) < -n:
            heapq.heappush(heap, (-len(both), a, b))
            continue
        node = plan.size
        plan.sums.append((a, b))
        holders[a] -= both
        holders[b] -= both
        for k in both:
            left[k] -= {a, b}
        near = Counter(s for k in both for s in left[k])
        for k in both:
            left[k].add(node)
        holders[node] = both
        for s, m in near.items():
            if m > 1:
                heapq.heappush(heap, (-m, s, node))
    plan.roots = [sorted(symbols) for symbols in left]
    return plan


class Terms:
    """The terms of a pass, found among the words of a slice by fingerprint and then compared byte by byte."""

    def __init__(self, terms: list[str]):
        raw = [t.encode() for t in terms]
        hashes = np.concatenate([np.zeros(0, np.uint64), *(s.hashes(s.bounds[:-1], s.bounds[1:]) for s in slices(pa.array(terms, pa.string()), apart=APART))])
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        self.lengths = np.array([len(r) for r in raw], np.int64)
        self.long = {k: r for k, r in enumerate(raw) if len(r) > SHORT}
        width = max([len(r) for r in raw if len(r) <= SHORT], default=1)
        self.bytes = np.zeros((len(raw), width), np.uint8)
        for k, r in enumerate(raw):
            if len(r) <= SHORT:
                self.bytes[k, :len(r)] = np.frombuffer(r, np.uint8)

    def find(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of ``s`` that are terms, and which terms they are."""
        if not len(self.hashes) or not len(s.starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, s.words), len(self.hashes) - 1)
        word = np.flatnonzero(self.hashes[at] == s.words)
        term = self.order[at[word]]
        lengths = s.ends[word] - s.starts[word]
        same = lengths == self.lengths[term]
        word, term, lengths = word[same], term[same], lengths[same]
        reach = np.arange(self.bytes.shape[1])
        keep = np.zeros(len(word), bool)
        for part in range(0, len(word), 1 << 16):
            w, t, n = (x[part:part + (1 << 16)] for x in (word, term, lengths))
            places = np.minimum(s.starts[w][:, None] + reach, len(s.data) - 1)
            keep[part:part + (1 << 16)] = ((s.data[places] == self.bytes[t]) | (reach >= n[:, None])).all(1) | (n > SHORT)
        for k in np.flatnonzero(lengths > SHORT):
            keep[k] = s.data[s.starts[word[k]]:s.ends[word[k]]].tobytes() == self.long[int(term[k])]
        return word[keep], term[keep]


POSTINGS = "doc_id long, n long, terms array<int>, counts array<long>"


def _read(terms_of):
    """``mapInArrow`` function from (doc_id, text) to a row (doc_id, n, terms, counts) for each document with a term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = terms_of()
        most = max(1, len(terms.lengths))
        for batch in batches:
            ids = batch.column("doc_id")
            for s in slices(batch.column("text"), lower=True, apart=APART):
                n = np.diff(s.word_bounds)
                word, term = terms.find(s)
                key = (np.searchsorted(s.word_bounds, word, side="right") - 1) * most + term
                key, counts = np.unique(key, return_counts=True)
                bounds = np.searchsorted(key // most, np.arange(s.n + 1)).astype(np.int32)
                rows = pa.array(n > 0)
                lists = [pa.ListArray.from_arrays(bounds, values) for values in (pa.array((key % most).astype(np.int32)), pa.array(counts.astype(np.int64)))]
                yield pa.RecordBatch.from_arrays([ids.slice(s.first, s.n), pa.array(n.astype(np.int64)), *lists], names=["doc_id", "n", "terms", "counts"]).filter(rows)
    return run


def impacts(counts: np.ndarray, n: np.ndarray, documents: int, words: int) -> np.ndarray:
    """(1000000000 * tf) div (1000 * tf + 12 * m) of a term's occurrences in documents of n terms, exact where 64 bits would not do for m."""
    factor = 25 * documents
    if int(n.max(initial=0)) * factor < 1 << 62:
        m = 75 + n * factor // words
    else:
        m = np.array([75 + int(x) * factor // words for x in n], np.int64)
    return 1_000_000_000 * counts // (1000 * counts + 12 * m)


def accumulate(plan: Plan, leaves: np.ndarray, columns: np.ndarray, values: np.ndarray, documents: int) -> np.ndarray:
    """Scores (items x documents) of a slice of documents; ``values`` are those of the leaves at the documents ``columns``."""
    acc = np.zeros((plan.size, documents), np.int64)
    acc[leaves, columns] = values
    k = len(plan.terms)
    for leaf, times in plan.scaled:
        np.multiply(acc[leaf], times, out=acc[k])
        k += 1
    for a, b in plan.sums:
        np.add(acc[a], acc[b], out=acc[k])
        k += 1
    return np.stack([acc[roots].sum(0) for roots in plan.roots]) if plan.roots else np.zeros((0, documents), np.int64)


class Best:
    """The best (score, then least id) of each item so far."""

    def __init__(self, items: int, top: int):
        self.top, self.low = top, np.ones(items, np.int64)
        self.rows = [np.zeros(0, np.int64) for _ in range(4)]

    def add(self, items: np.ndarray, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        """``scores`` of ``items`` (rows) for the documents ``ids`` (columns)."""
        row, column = np.nonzero(scores >= self.low[items][:, None])
        if not len(row):
            return
        new = (items[row], scores[row, column], ids[column], missing[column])
        item, score, doc, gone = (np.concatenate(x) for x in zip(self.rows, new))
        order = np.lexsort((gone, doc, -score, item))
        item, score, doc, gone = item[order], score[order], doc[order], gone[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        keep = place < self.top
        self.rows = [x[keep] for x in (item, score, doc, gone)]
        last = place == self.top - 1
        self.low[item[last]] = score[last]


HITS = "item int, doc_id long, score long"


def _score(plans_of, params: SearchParams):
    """``mapInArrow`` function from postings to the best documents of each item in this task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans, weights, documents, words, n_items = plans_of()
        leaf_of = []
        for plan in plans:
            leaf = np.full(len(weights), -1, np.int64)
            leaf[plan.terms] = np.arange(len(plan.terms))
            leaf_of.append(leaf)
        best = Best(n_items, params.top)
        for batch in batches:
            lists, tf = batch.column("terms"), batch.column("counts").flatten().to_numpy(zero_copy_only=False)
            bounds = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
            term = lists.flatten().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(batch)), np.diff(bounds))
            n = np.asarray(batch.column("n"))
            value = weights[term] * impacts(tf, n[doc], documents, words)
            missing = np.asarray(batch.column("doc_id").is_null()).astype(np.int64)
            ids = np.asarray(batch.column("doc_id").fill_null(NO_ID))
            for plan, leaf in zip(plans, leaf_of):
                step = max(16, params.matrix_bytes // (8 * max(1, plan.size)))
                items = np.array(plan.items, np.int64)
                for low in range(0, len(batch), step):
                    high = min(low + step, len(batch))
                    part = slice(bounds[low], bounds[high])
                    mine = leaf[term[part]] >= 0
                    if mine.any():
                        scores = accumulate(plan, leaf[term[part]][mine], (doc[part] - low)[mine], value[part][mine], high - low)
                        best.add(items, scores, ids[low:high], missing[low:high])
        item, score, doc, gone = best.rows
        if len(item):
            yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(doc, mask=gone.astype(bool)), pa.array(score)], names=["item", "doc_id", "score"])
    return run


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term, times, pass) with items numbered; rows alike in item_id and text are one item."""
    found = items.select("item_id", F.col("text").cast("string").alias("text")).distinct().filter("text IS NOT NULL")
    numbered = store(found.withColumn("item", F.monotonically_increasing_id()), "items")
    terms = numbered.select("item", "item_id", F.explode(F.expr(f"regexp_extract_all(text, r'{TERM}', 0)")).alias("term"))
    return terms.groupBy("item", "item_id", F.translate("term", UPPER, LOWER).alias("term")).agg(F.count("*").cast("int").alias("times"))


def lexical_search(docs: DataFrame, items: DataFrame, params: SearchParams | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): the best documents of ``docs`` (doc_id, text) for each of ``items`` (item_id, text).

    Null and empty texts have no terms: such documents are in no statistic and such items have no rows. Repeated documents count and rank
    each, with ranks of their own; a missing doc_id comes after others of the same score; items alike in id and text are one, those alike
    in id only are ranked each; empty tables give an empty result; other columns may have any name.
    """
    p = params or SearchParams()
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    wanted = store(item_terms(items), "item-terms")
    passes = max(1, math.ceil(wanted.count() / p.pass_terms))
    found = []
    for number in range(passes):
        mine = wanted.filter(F.pmod(F.xxhash64("item"), F.lit(passes)) == number).collect()  # about pass_terms rows
        if not mine:
            continue
        names = sorted({r.term for r in mine})
        number_of = {t: k for k, t in enumerate(names)}
        ids = {r["item"]: r.item_id for r in mine}
        place = {x: k for k, x in enumerate(sorted(ids))}
        counts: dict[int, Counter] = defaultdict(Counter)
        for r in mine:
            counts[place[r["item"]]][number_of[r.term]] = r.times
        shared_terms = spark.sparkContext.broadcast(names)
        postings = store(rows.mapInArrow(_read(lambda: Terms(shared_terms.value)), POSTINGS), "postings")
        total = postings.agg(F.count("*").alias("documents"), F.sum("n").alias("words")).first()
        if not total.documents:
            break
        held = dict(postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # a row for each term of the pass
        weights = np.array([math.floor(1000 * math.log((2 * total.documents + 2) / (2 * held.get(k, 0) + 1))) for k in range(len(names))], np.int64)
        keys = sorted(counts, key=lambda k: (sorted(counts[k], key=lambda t: (-held.get(t, 0), t))[:4], k))
        plans = [share({k: counts[k] for k in keys[i:i + p.plan_items]}, p.mined) for i in range(0, len(keys), p.plan_items)]
        shared_plans = spark.sparkContext.broadcast((plans, weights, total.documents, total.words, len(place)))
        hits = postings.filter(F.size("terms") > 0).mapInArrow(_score(lambda: shared_plans.value, p), HITS)
        schema = f"item int, item_id {wanted.schema['item_id'].dataType.simpleString()}"
        numbered = spark.createDataFrame([(place[x], ids[x]) for x in sorted(ids)], schema)
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= p.top)
        found.append(ranked.join(F.broadcast(numbered), "item").select("item_id", "rank", "doc_id", "score"))
    if not found:
        return spark.createDataFrame([], f"item_id {wanted.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
