"""Quality classifier: a convolutional network over bytes, in numpy.

A text is covered by overlapping chunks of bytes. Bytes are embedded (a byte that starts a run repeated a few bytes later in its
chunk has a vector of its own, so that stammering can be learned), learned filters run over each chunk and
are max-pooled in it; a linear layer gives a logit for each chunk, and the mean logit of all chunks gives the
probability of the text. Fitting takes a bounded sample of labelled rows; scoring reads every byte of every text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argusframe.llm.labelled import fold_of, labelled_sample
from argusframe.llm.textbatch import slices

PAD = 256
SYMBOLS = 2 * 256 + 1


@dataclass(frozen=True)
class ByteCnnParams:
    """``per_label`` rows of each label and ``max_bytes`` of a text bound the sample for fitting."""

    chunk: int = 512
    step: int = 448
    stride: int = 4
    dims: int = 4
    filters: int = 24
    per_label: int = 1500
    max_bytes: int = 32_768
    epochs: int = 8
    batch: int = 48
    rate: float = 0.01
    seed: int = 5
    run: int = 4
    farthest: int = 20
    keep_weight: float = 2.0


class ByteCnn:
    def __init__(self, p: ByteCnnParams):
        rng = np.random.default_rng(p.seed)
        self.p = p
        wide = 2 * p.stride * p.dims
        self.w = {"emb": rng.normal(0, 0.5, (SYMBOLS, p.dims)), "filters": rng.normal(0, 1 / np.sqrt(wide), (wide, p.filters)),
                  "bias": np.zeros(p.filters), "out": rng.normal(0, 0.3, p.filters), "base": np.zeros(1)}
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def chunks(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all chunks (padded) and the first chunk of each text; an empty text has one chunk of padding."""
        p = self.p
        size = np.diff(bounds)
        many = 1 + np.maximum(0, -(-(size - p.chunk) // p.step))
        heads = np.concatenate([[0], np.cumsum(many)])
        number = np.arange(heads[-1]) - np.repeat(heads[:-1], many)
        at = np.repeat(bounds[:-1], many) + number * p.step
        left = np.repeat(bounds[1:], many) - at
        padded = np.concatenate([data, np.zeros(p.chunk, np.uint8)])
        raw = padded[at[:, None] + np.arange(p.chunk)]
        beyond = np.arange(p.chunk) >= left[:, None]
        raw[beyond] = 0
        again = np.zeros(raw.shape, bool)
        for lag in range(2, p.farthest + 1):
            same = raw[:, :-lag] == raw[:, lag:]
            run = same[:, :-p.run + 1].copy()
            for k in range(1, p.run):
                run &= same[:, k:same.shape[1] - p.run + 1 + k]
            again[:, :run.shape[1]] |= run
        out = raw.astype(np.int16)
        out[again] += PAD + 1
        out[beyond] = PAD
        return out, heads

    def pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Largest response of each filter in each chunk, its place, and the embedded blocks."""
        p, w = self.p, self.w
        x = w["emb"][chunks].reshape(len(chunks), p.chunk // p.stride, p.stride * p.dims)
        half = p.stride * p.dims
        y = x[:, :-1] @ w["filters"][:half]
        y += x[:, 1:] @ w["filters"][half:]
        best = y.argmax(1)
        return np.take_along_axis(y, best[:, None], 1)[:, 0] + w["bias"], best, x

    def logits(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        chunks, heads = self.chunks(data, bounds)
        each = np.concatenate([np.maximum(self.pooled(chunks[k:k + 512])[0], 0) @ self.w["out"] for k in range(0, len(chunks), 512)]) + self.w["base"]
        return np.add.reduceat(each, heads[:-1]) / np.diff(heads)

    def fit(self, texts: list[bytes], labels: np.ndarray) -> "ByteCnn":
        """Adam on the log loss; label 1 weighs ``keep_weight`` times label 0 in sum."""
        p, rng = self.p, np.random.default_rng(self.p.seed + 1)
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        share = np.array([max(1, (labels == y).sum()) for y in (0, 1)])
        weight = (len(labels) / (1 + p.keep_weight) / share * [1, p.keep_weight])[labels]
        t = 0
        for epoch in range(p.epochs):
            order = rng.permutation(len(texts))
            for k in range(0, len(order), p.batch):
                some = order[k:k + p.batch]
                grad = self._gradient([texts[i] for i in some], labels[some], weight[some])
                t += 1
                rate = p.rate * (1 - epoch / p.epochs)
                for name, g in grad.items():
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.99 * second[name] + 0.01 * g * g
                    self.w[name] = (self.w[name] - rate * (first[name] / (1 - 0.9**t)) / (np.sqrt(second[name] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return self

    def _gradient(self, texts: list[bytes], labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, w = self.p, self.w
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        chunks, heads = self.chunks(np.frombuffer(b"".join(texts), np.uint8), bounds)
        top, best, x = self.pooled(chunks)
        active = np.maximum(top, 0)
        many = np.diff(heads)
        logit = np.add.reduceat(active @ w["out"] + w["base"], heads[:-1]) / many
        miss = (1 / (1 + np.exp(-logit)) - labels) * weight / len(texts)
        each = np.repeat(miss / many, many)
        back = each[:, None] * w["out"] * (top > 0)
        rows = np.arange(len(chunks))[:, None]
        seen = np.concatenate([x[rows, best], x[rows, best + 1]], 2)
        places = best[:, :, None] * p.stride + np.arange(2 * p.stride)
        spread = back[:, :, None, None] * w["filters"].T.reshape(p.filters, 2 * p.stride, p.dims)
        emb = np.zeros_like(w["emb"])
        symbols = chunks[rows[:, :, None], places].ravel()
        for d in range(p.dims):
            emb[:, d] = np.bincount(symbols, spread[..., d].ravel(), minlength=SYMBOLS)
        return {"emb": emb, "filters": np.einsum("ck,ckw->wk", back, seen), "bias": back.sum(0), "out": active.T @ each, "base": each.sum(keepdims=True)}


def fit_quality(docs: DataFrame, labels: DataFrame, folds: int, held_out: int, params: ByteCnnParams) -> ByteCnn:
    rows = labelled_sample(docs, labels, "quality", folds, held_out, params.per_label, params.max_bytes)
    model = ByteCnn(params)
    return model.fit([t.encode() for t, _, _ in rows], np.array([y for _, _, y in rows])) if rows else model


def score_quality(docs: DataFrame, model: ByteCnn) -> DataFrame:
    """(doc_id, score) for each row of ``docs``, from the text alone."""

    def score(batches):
        for batch in batches:
            for s in slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(s.first, s.n), pa.array(1 / (1 + np.exp(-model.logits(s.data, s.bounds).astype(np.float64))))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id bigint, score double")


def quality_classifier(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = 0.7, params: ByteCnnParams | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``.

    A null text is scored as an empty one; repeated rows get equal scores; labels other than 0 and 1 are ignored, and without
    labels the untrained network scores; an empty table gives an empty result; only doc_id and text are read.
    """
    model = fit_quality(docs, labels, folds, held_out, params or ByteCnnParams())
    return score_quality(docs, model).select("doc_id", (fold_of("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
