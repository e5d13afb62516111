"""Toxicity classifier: a convolutional network over words, in numpy.

Words (letters and digits, small ASCII letters) are hashed to embeddings. Filters of several widths run over the
words and are max-pooled over the whole text; a linear layer gives the probability. A bucket remembers the
fingerprint of the word it was fitted for, so the many words never seen in fitting share the zero vector instead
of meeting a toxic word's bucket by chance. Fitting takes every word of every labelled row: Spark counts the words, each
partition steps through its texts, and the weights of the partitions are averaged after each epoch. Scoring reads every
word of every text. Thresholds for flagging are calibrated by language on a fifth of the labelled rows, which is not fitted; the score
knows no language.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argusframe.llm.common import shuffle_width, store
from argusframe.llm.labelled import fold_of, labelled_rows
from argusframe.llm.quality_rules import language
from argusframe.llm.textbatch import as_long, slices
from argusframe.session import cut_lineage

#: Weights travel in rows of so many lanes, as whole numbers of 1 / ONE, so their sums don't depend on the order of partitions.
LANES = 8
ONE = 1 << 20
#: Words that are scored together when thresholds are calibrated.
SPAN = 200_000
GRID = np.arange(0.05, 0.96, 0.05)

_APART = np.ones(256, bool)
for _first, _last in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _APART[_first:_last + 1] = False


@dataclass(frozen=True)
class TextCnnParams:
    """``words`` bounds the fitted vocabulary. ``per_label`` and ``max_bytes`` are still accepted but bound nothing: every labelled row is fitted whole."""

    bits: int = 20
    words: int = 8192
    least_texts: int = 4
    prior: float = 4.0
    dims: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    per_label: int = 2500
    max_bytes: int = 32_768
    epochs: int = 4
    rate: float = 0.05
    seed: int = 7


def word_ids(texts: pa.Array):
    """Slices with word fingerprints of ``texts``."""
    return slices(texts, lower=True, apart=_APART)


class TextCnn:
    def __init__(self, p: TextCnnParams):
        rng = np.random.default_rng(p.seed)
        self.p = p
        self.bucket = np.zeros(1 << p.bits, np.int32)
        self.print = np.zeros(1, np.uint64)
        self.emb = np.zeros((1, p.dims), np.float32)
        self.filters = [rng.normal(0, 0.3, (w, p.dims, p.filters)).astype(np.float32) for w in p.widths]
        for f in self.filters:  # one filter of each width starts out listening to the evidence dimension
            f[:, 0, 0] = 1.0
        self.bias = [np.zeros(p.filters, np.float32) for _ in p.widths]
        self.out = np.full((len(p.widths), p.filters), 0.3, np.float32)
        self.base = np.float32(-1)

    def rows(self, words: np.ndarray) -> np.ndarray:
        """Embedding row of each word; 0 for words not seen in fitting."""
        at = self.bucket[(words >> np.uint64(64 - self.p.bits)).astype(np.int64)]
        return np.where(self.print[at] == words, at, 0)

    def choose(self, words: np.ndarray, n: np.ndarray, toxic: np.ndarray, total: list[int], rng) -> None:
        """Take the words that tell the labels apart best. ``n`` texts have a word, ``toxic`` of them toxic ones; ``total``: texts by label.

        Embeddings start from how much more often than expected (with a prior) a word is in toxic texts."""
        p = self.p
        expected = n * total[1] / sum(total)
        odds = np.log((toxic + p.prior) / (expected + p.prior))
        strong = np.abs(toxic - expected) / np.sqrt(expected + 1)
        chosen = np.flatnonzero(n >= p.least_texts)
        chosen = chosen[np.lexsort((words[chosen], -strong[chosen]))][:p.words]
        self.print = np.concatenate([np.zeros(1, np.uint64), words[chosen]])
        slot = (words[chosen] >> np.uint64(64 - p.bits)).astype(np.int64)
        self.bucket[slot[::-1]] = np.arange(len(chosen), 0, -1)  # the stronger word keeps a shared bucket
        self.emb = rng.normal(0, 0.05, (len(chosen) + 1, p.dims)).astype(np.float32)
        self.emb[1:, 0] = 2 * odds[chosen]
        self.emb[0] = 0

    def fit(self, texts: list[np.ndarray], labels: np.ndarray) -> "TextCnn":
        """``texts``: word fingerprints. AdaGrad on the log loss, a text at a time."""
        p, rng = self.p, np.random.default_rng(self.p.seed + 1)
        present = [np.unique(t) for t in texts]
        total = [max(1, int((labels == y).sum())) for y in (0, 1)]
        seen, inverse = np.unique(np.concatenate(present) if present else np.zeros(0, np.uint64), return_inverse=True)
        owner = np.repeat(labels, [len(t) for t in present])
        counts = np.stack([np.bincount(inverse[owner == y], minlength=len(seen)) for y in (0, 1)]) if len(seen) else np.zeros((2, 0))
        self.choose(seen, counts.sum(0), counts[1], total, rng)
        ids = [self.rows(t) for t in texts]
        weight = (sum(total) / 2 / np.array(total))[labels]
        self.sums = {}
        for _ in range(p.epochs):
            for i in rng.permutation(len(ids)):
                self._step(ids[i], labels[i], weight[i])
        del self.sums
        return self

    def _state(self) -> list[tuple]:
        """Name and value of all that a step changes but ``base``."""
        return [("emb", self.emb), ("out", self.out), *((("filters", k), f) for k, f in enumerate(self.filters)), *((("bias", k), b) for k, b in enumerate(self.bias))]

    def packed(self) -> np.ndarray:
        """Weights and sums of squares as rows of ``LANES`` numbers."""
        flat = [x.ravel() for name, value in self._state() for x in (value, self.sums.get(name, np.full(value.shape, 1e-2)))]
        flat = np.concatenate([np.array([self.base]), *flat]).astype(np.float64)
        return np.concatenate([flat, np.zeros(-len(flat) % LANES)]).reshape(-1, LANES)

    def unpack(self, rows: np.ndarray) -> None:
        flat, at = rows.ravel().astype(np.float32), 1
        self.base, self.sums = flat[0], {}
        for name, value in self._state():
            value[...] = flat[at:at + value.size].reshape(value.shape)
            self.sums[name] = flat[at + value.size:at + 2 * value.size].reshape(value.shape).copy()
            at += 2 * value.size

    def _update(self, name, value: np.ndarray, grad: np.ndarray, at=slice(None)) -> None:
        total = self.sums.setdefault(name, np.full(value.shape, 1e-2, np.float32))
        total[at] += grad * grad
        value[at] -= self.p.rate * grad / np.sqrt(total[at])

    def _step(self, ids: np.ndarray, label: int, weight: float) -> None:
        p, reach = self.p, max(self.p.widths)
        padded = np.concatenate([ids, np.zeros(reach, ids.dtype)])
        x = self.emb[padded]
        n = len(ids) + 1
        tops, places = [], []
        for f, b in zip(self.filters, self.bias):
            z = sum(x[j:j + n] @ f[j] for j in range(len(f))) + b
            best = z.argmax(0)
            tops.append(z[best, np.arange(p.filters)])
            places.append(best)
        top = np.stack(tops)
        miss = np.float32((1 / (1 + np.exp(-(np.sum(self.out * np.maximum(top, 0)) + self.base))) - label) * weight)
        back = miss * self.out * (top > 0)
        self._update("out", self.out, miss * np.maximum(top, 0))
        self.base -= np.float32(0.01) * miss
        for k, (f, b, best) in enumerate(zip(self.filters, self.bias, places)):
            near = best[:, None] + np.arange(len(f))
            grad = back[k][:, None, None] * x[near]
            rows, spread = padded[near].ravel(), (back[k][:, None, None] * f.transpose(2, 0, 1)).reshape(-1, p.dims)
            self._update(("filters", k), f, grad.transpose(1, 2, 0))
            self._update(("bias", k), b, back[k])
            own, back_to = np.unique(rows, return_inverse=True)
            summed = np.zeros((len(own), p.dims), np.float32)
            np.add.at(summed, back_to, spread)
            summed[own == 0] = 0
            self._update("emb", self.emb, summed, own)

    def logits(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Logit of each text; ``bounds``: first word of each text and the end. Filters see zero words beyond a text's ends."""
        return self.row_logits(self.rows(words), bounds)

    def row_logits(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The same from the embedding rows of the words."""
        n, reach = len(bounds) - 1, max(self.p.widths)
        size = np.diff(bounds)
        shift = np.repeat(np.arange(n) * reach, size)
        padded = np.zeros(len(words) + (n + 1) * reach, np.int64)
        padded[np.arange(len(words)) + shift] = words
        heads = bounds[:-1] + np.arange(n) * reach
        total = np.full(n, self.base, np.float64)
        span = len(words) + n * reach
        # A text has a window at each of its words and one of zero words alone; those behind it reach into the next text.
        own = np.arange(span) - np.repeat(heads, size + reach) <= np.repeat(size, size + reach)
        for f, b, v in zip(self.filters, self.bias, self.out):
            z = (self.emb @ f[0])[padded[:span]]
            for j in range(1, len(f)):
                z += (self.emb @ f[j])[padded[j:span + j]]
            z[~own] = -np.inf
            total += np.maximum(np.maximum.reduceat(z, heads) + b, 0) @ v
        return total


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n, toxic): in how many texts of ``rows`` (text, label) a word is, and in how many of label 1."""

    def count(batches):
        for batch in batches:
            labels = batch.column("label").to_numpy()
            for s in word_ids(batch.column("text")):
                owner = np.repeat(np.arange(s.n), np.diff(s.word_bounds))
                order = np.lexsort((s.words, owner))
                words, owner = s.words[order], owner[order]
                first = np.ones(len(words), bool)
                first[1:] = (words[1:] != words[:-1]) | (owner[1:] != owner[:-1])
                seen, inverse = np.unique(words[first], return_inverse=True)
                toxic = np.bincount(inverse, weights=labels[s.first + owner[first]], minlength=len(seen)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([as_long(seen), pa.array(np.bincount(inverse, minlength=len(seen))), pa.array(toxic)], names=["word", "n", "toxic"])

    counts = rows.select("text", "label").mapInArrow(count, "word bigint, n bigint, toxic bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def _coded(rows: DataFrame, model: TextCnn) -> DataFrame:
    """(doc_id, lang, label, ids) of ``rows``: the embedding rows of a text's words, as 32-bit numbers."""

    def code(batches):
        for batch in batches:
            for s in word_ids(batch.column("text")):
                ids = model.rows(s.words).astype(np.int32)
                langs = pa.array([language(x) for x in batch.column("lang").slice(s.first, s.n).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(s.first, s.n), langs, batch.column("label").slice(s.first, s.n),
                                                  pa.array([ids[a:b].tobytes() for a, b in zip(s.word_bounds[:-1], s.word_bounds[1:])], pa.binary())],
                                                 names=["doc_id", "lang", "label", "ids"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "label").mapInArrow(code, "doc_id bigint, lang string, label int, ids binary")


def _epoch(coded: DataFrame, model: TextCnn, weight: np.ndarray, number: int) -> None:
    """One pass over ``coded``: each partition goes on from the weights of ``model``, which then takes the mean of theirs by texts."""

    light = copy.copy(model)
    light.bucket = light.print = None  # steps take embedding rows

    def train(batches):
        rng, n = np.random.default_rng([light.p.seed, number]), 0
        for batch in batches:
            labels, texts = batch.column("label").to_numpy(), batch.column("ids")
            for i in rng.permutation(len(labels)):
                light._step(np.frombuffer(texts[i].as_py(), np.int32), labels[i], weight[labels[i]])
            n += len(labels)
        if n:
            rows = np.rint(light.packed() * ONE).astype(np.int64) * n
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array(np.full(len(rows), n)), *(pa.array(rows[:, k]) for k in range(LANES))],
                                             names=["at", "n", *(f"v{k}" for k in range(LANES))])

    lanes = [f"v{k}" for k in range(LANES)]
    parts = coded.select("label", "ids").mapInArrow(train, f"at bigint, n bigint, {', '.join(f'{v} bigint' for v in lanes)}")
    mean = parts.groupBy("at").agg(F.sum("n").alias("n"), *(F.sum(v).alias(v) for v in lanes)).orderBy("at").toPandas()
    if len(mean):
        model.unpack(mean[lanes].to_numpy() / mean[["n"]].to_numpy() / ONE)


def _calibrated(coded: DataFrame, model: TextCnn) -> dict[str, float]:
    """The threshold of each language of ``coded``, from counts of its scores between the steps of ``GRID``."""

    def score(batches):
        for batch in batches:
            ids = batch.column("ids")
            size = np.array([len(x.as_py()) // 4 for x in ids], np.int64)
            cuts = np.flatnonzero(np.diff((np.cumsum(size) - size) // SPAN)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(size)]):
                rows = np.frombuffer(b"".join(x.as_py() for x in ids[a:b]), np.int32)
                scores = 1 / (1 + np.exp(-model.row_logits(rows, np.concatenate([[0], np.cumsum(size[a:b])]))))
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(a, b - a), batch.column("label").slice(a, b - a),
                                                  pa.array(np.searchsorted(GRID, scores, side="right").astype(np.int32))], names=["lang", "label", "step"])

    steps = np.concatenate([[0.0], GRID])
    counts: dict[str, np.ndarray] = {}
    for r in coded.select("lang", "label", "ids").mapInArrow(score, "lang string, label int, step int").groupBy("lang", "label", "step").count().collect():
        counts.setdefault(r.lang, np.zeros((len(steps), 2), np.int64))[r.step, r.label] = r["count"]
    return {lang: best_threshold(steps, n) for lang, n in sorted(counts.items())}


def fit_toxicity(docs: DataFrame, labels: DataFrame, folds: int, held_out: int, params: TextCnnParams) -> tuple[TextCnn, dict[str, float]]:
    """The network, fitted on about four fifths of all labelled rows, and the threshold of each language on the others (best F1; 0.5 below 25 rows of a label).

    Which rows are fitted goes by the hash of the id. Languages go by ``quality_rules.language`` of the row's code, so that en, EN and en-US are one."""
    rows = store(labelled_rows(docs, labels, "toxic", folds, held_out), "labelled")  # texts are moved once, not for each step that reads them
    order = F.xxhash64(F.col("doc_id").cast("long"), F.lit("toxic"))
    apart = F.pmod(order, F.lit(5)) == 4
    model, fitted = TextCnn(params), rows.filter(~apart)
    number = {r.label: r["count"] for r in fitted.groupBy("label").count().collect()}
    total = [max(1, number.get(y, 0)) for y in (0, 1)]
    # The order of ``TextCnn.choose``, so no more words than it takes come to the driver.
    expected = F.col("n") * (total[1] / sum(total))
    strong = F.abs(F.col("toxic") - expected) / F.sqrt(expected + 1)
    words = word_counts(fitted).filter(F.col("n") >= params.least_texts).orderBy(strong.desc(), "word").limit(params.words).toPandas()
    model.choose(words["word"].to_numpy(np.int64).view(np.uint64), words["n"].to_numpy(np.float64), words["toxic"].to_numpy(np.float64), total, np.random.default_rng(params.seed + 1))
    # A partition for each core: each has its own weights, so more of them learn less each and cost more to average.
    spark = docs.sparkSession
    workers = max(1, min(shuffle_width(spark), spark.sparkContext.defaultParallelism))
    coded = cut_lineage(_coded(rows, model).repartition(workers, "doc_id").sortWithinPartitions(order, "doc_id", "ids")).coalesce(workers)
    weight = sum(total) / 2 / np.array(total)
    model.sums = {}
    for epoch in range(params.epochs):
        _epoch(coded.filter(~apart), model, weight, epoch)
    del model.sums
    return model, _calibrated(coded.filter(apart), model)


def best_threshold(scores: np.ndarray, truth: np.ndarray, least: int = 25) -> float:
    """The step of ``GRID`` with the best F1; ``truth`` is the label of each score, or how many have label 0 and 1."""
    none, toxic = (truth == [[0], [1]]).astype(np.int64) if truth.ndim == 1 else truth.T
    if min(none.sum(), toxic.sum()) < least:
        return 0.5
    f1 = [2 * toxic[scores >= t].sum() / max(1, (none + toxic)[scores >= t].sum() + toxic.sum()) for t in GRID]
    return float(GRID[int(np.argmax(f1))])


def score_toxicity(docs: DataFrame, model: TextCnn) -> DataFrame:
    """(doc_id, lang, score) for each row of ``docs``, the score from the text alone; ``lang`` is the language of the code, as for thresholds."""

    def score(batches):
        for batch in batches:
            for s in word_ids(batch.column("text")):
                logits = model.logits(s.words, s.word_bounds)
                langs = pa.array([language(x) for x in batch.column("lang").slice(s.first, s.n).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(s.first, s.n), langs, pa.array(1 / (1 + np.exp(-logits)))],
                                                 names=["doc_id", "lang", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").mapInArrow(score, "doc_id bigint, lang string, score double")


def toxicity_classifier(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, threshold: float = 0.5, params: TextCnnParams | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted, flagged) for each row of ``docs``; flagged uses the threshold of the row's language.

    A null text is scored as an empty one; repeated rows get equal scores; labels other than 0 and 1 are ignored, and without
    labels the untrained network scores; an unknown language has threshold 0.5; an empty table gives an empty result; other
    columns are not read.
    """
    model, thresholds = fit_toxicity(docs, labels, folds, held_out, params or TextCnnParams())
    limit = F.lit(0.5)
    for code, value in thresholds.items():
        limit = F.when(F.col("lang") == code, value).otherwise(limit)
    return score_toxicity(docs, model).select("doc_id", (fold_of("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
                                              (F.col("score") >= limit).alias("flagged"))
