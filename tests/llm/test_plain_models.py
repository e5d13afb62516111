"""The numeric cores against plain loops."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from argusframe.llm.byte_cnn import PAD, ByteCnn, ByteCnnParams
from argusframe.llm.labelled import labelled_sample
from argusframe.llm.quality_rules import WORDS, QualityLimits, distance, good_documents, quality_rules
from argusframe.llm.sharding import WEIGHTS, pack_vectors, vector_sharding
from argusframe.llm.sketches import likeness, recovered_digests
from argusframe.llm.text_cnn import TextCnn, TextCnnParams, fit_toxicity, score_toxicity, toxicity_classifier, word_counts, word_ids


def byte_logit(model: ByteCnn, text: bytes) -> float:
    """One text through the network by hand."""
    p, w = model.p, model.w
    starts = [0]
    while starts[-1] + p.chunk < len(text):
        starts.append(starts[-1] + p.step)
    total = 0.0
    for start in starts:
        raw = text[start:start + p.chunk]
        padded = raw + bytes(p.chunk - len(raw))
        symbols = list(padded)
        for lag in range(2, p.farthest + 1):
            for k in range(p.chunk - lag - p.run + 1):
                if all(padded[k + j] == padded[k + j + lag] for j in range(p.run)):
                    symbols[k] = padded[k] + PAD + 1
        symbols[len(raw):] = [PAD] * (p.chunk - len(raw))
        best = np.full(p.filters, -np.inf)
        for at in range(0, p.chunk - p.stride, p.stride):
            window = np.concatenate([w["emb"][s] for s in symbols[at:at + 2 * p.stride]])
            best = np.maximum(best, window @ w["filters"])
        total += np.maximum(best + w["bias"], 0) @ w["out"] + w["base"][0]
    return total / len(starts)


def test_byte_network_forward_and_gradient():
    rng = np.random.default_rng(4)
    model = ByteCnn(ByteCnnParams(chunk=64, step=56, filters=5))
    model.w = {k: v.astype(np.float64) + rng.normal(0, 0.05, v.shape) for k, v in model.w.items()}
    texts = [b"", b"short", b"abcdabcdabcd again and again and again", bytes(rng.integers(0, 256, 200, dtype=np.uint8)), "é words".encode() * 30]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(b"".join(texts), np.uint8)
    assert np.allclose(model.logits(data, bounds), [byte_logit(model, t) for t in texts], atol=1e-9)

    labels, weight = np.array([1, 0, 1, 0, 1]), np.array([1.0, 0.5, 2.0, 1.5, 1.0])

    def loss() -> float:
        z = model.logits(data, bounds)
        return float(np.sum(weight * (np.logaddexp(0, z) - labels * z)) / len(texts))

    grad = model._gradient(texts, labels, weight)
    for name, value in model.w.items():
        places = np.argsort(-np.abs(grad[name]).ravel())[:12]
        for at in np.unravel_index(places, value.shape)[0] if value.ndim == 1 else zip(*np.unravel_index(places, value.shape)):
            before, step = value[at], 1e-6
            value[at] = before + step
            up = loss()
            value[at] = before - step
            down = loss()
            value[at] = before
            assert abs((up - down) / (2 * step) - grad[name][at]) < 1e-5, (name, at)


def word_logit(model: TextCnn, ids: list[int]) -> float:
    total = float(model.base)
    padded = [0] * 0 + ids + [0] * max(model.p.widths)
    for f, b, out in zip(model.filters, model.bias, model.out):
        for k in range(model.p.filters):
            best = max(sum(float(model.emb[padded[at + j]] @ f[j][:, k]) for j in range(len(f))) for at in range(len(ids) + 1))
            total += max(0.0, best + float(b[k])) * float(out[k])
    return total


def test_word_network_forward_and_gradient():
    rng = random.Random(2)
    vocabulary = [f"word{k}" for k in range(40)]
    texts = [" ".join(rng.choice(vocabulary[k % 2::2] if k % 3 else vocabulary) for _ in range(rng.randint(1, 30))) for k in range(80)] + ["", "unseen words only"]
    labels = np.array([k % 2 for k in range(len(texts))])
    model = TextCnn(TextCnnParams(bits=12, epochs=2))
    slices = list(word_ids(pa.array(texts)))
    ids = [s.words[a:b] for s in slices for a, b in zip(s.word_bounds[:-1], s.word_bounds[1:])]
    model.fit(ids, labels)
    logits = np.concatenate([model.logits(s.words, s.word_bounds) for s in slices])
    assert np.allclose(logits, [word_logit(model, model.rows(t).tolist()) for t in ids], atol=1e-4)

    for attribute in ("emb", "out"):
        setattr(model, attribute, getattr(model, attribute).astype(np.float64))
    model.filters, model.bias, model.base = [f.astype(np.float64) for f in model.filters], [b.astype(np.float64) for b in model.bias], np.float64(model.base)
    taken: dict = {}

    def take(name, value, grad, at=slice(None)):  # the embedding has a part from each width
        full = taken.setdefault(name, (value, np.zeros(value.shape)))[1]
        full[at] += grad
    model._update = take
    chosen, base = model.rows(ids[3]), model.base
    model._step(chosen, 1, 1.5)
    model.base = base

    def loss() -> float:
        z = word_logit(model, chosen.tolist())
        return 1.5 * (np.logaddexp(0, z) - z)

    for name, (value, full) in taken.items():
        for place in zip(*np.unravel_index(np.argsort(-np.abs(full).ravel())[:8], value.shape)):
            before, step = value[place], 1e-5
            value[place] = before + step
            up = loss()
            value[place] = before - step
            down = loss()
            value[place] = before
            assert abs((up - down) / (2 * step) - full[place]) < 1e-3 * max(1, abs(full[place])), (name, place)


def test_thresholds_go_by_the_language_of_the_code(spark):
    rng = random.Random(6)
    docs, labels = [], []
    for k in range(900):
        toxic = k % 3 == 0
        words = [rng.choice(["ra", "ne", "to", "li", "mu"]) + rng.choice("abc") for _ in range(rng.randint(10, 40))]
        docs.append((k, " ".join(words + (["grobian", "schuft"] if toxic else [])), rng.choice(["en", "EN", "en-US", "en_GB"])))
        labels.append((k, int(toxic)))
    docs += [(5000, "ra ne", None), (5001, "ra ne", "xx-YY")]
    frame, known = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    assert {r.lang for r in score_toxicity(frame, TextCnn(TextCnnParams(bits=10))).collect()} == {"en", "", "xx"}
    from unittest import mock

    from argusframe.llm import text_cnn
    with mock.patch.object(text_cnn, "best_threshold", lambda scores, truth, least=25: 0.25):
        rows = toxicity_classifier(frame, known, params=TextCnnParams(bits=12, per_label=200)).collect()
    assert all(r.flagged == (r.score >= (0.25 if r.doc_id < 5000 else 0.5)) for r in rows)


def test_labelled_sample_draws_among_texts_that_fit(spark):
    docs = spark.createDataFrame([(k, "x" * (100 if k % 4 else 5000), "en") for k in range(200)] + [(7, "second text", "de"), (300, None, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(11, 0), (13, 1), (None, 1), (300, 1), (400, 0)], "doc_id long, quality int")
    rows = labelled_sample(docs, labels, "quality", 1000, 999, 30, 1000)
    assert sum(y == 0 for _, _, y in rows) >= 30 and all(len(t) <= 1000 for t, _, _ in rows)
    assert rows == labelled_sample(docs.repartition(5), labels.repartition(3), "quality", 1000, 999, 30, 1000)
    every = labelled_sample(docs, labels, "quality", 1000, 999, 1000, 1000)
    assert len(every) == 150 - 1 + 1 + 1  # 11 has both labels, 7 two texts, 300 none
    assert labelled_sample(docs, labels, "quality", 1000, 999, 30, -1) == []


def test_packing_of_vectors_equals_a_plain_loop():
    rng = np.random.default_rng(3)
    for shards, turn in ((4, 0), (16, 5)):
        vectors = np.stack([rng.integers(1, 500, 300), rng.integers(0, 80, 300), rng.integers(1, 4, 300)], 1).astype(float)
        capacity = vectors.sum(0) / shards
        share = [[v / c for v, c in zip(row, capacity)] for row in vectors.tolist()]
        room = [[1.0] * 3 for _ in range(shards)]
        expected = [0] * 300
        for i in sorted(range(300), key=lambda i: (-max(share[i]), i)):
            gains = [sum(r * s * w for r, s, w in zip(room[b], share[i], WEIGHTS)) for b in range(shards)]
            best = max(range(shards), key=lambda b: (gains[b], -b))
            room[best] = [r - s for r, s in zip(room[best], share[i])]
            expected[i] = (best + turn) % shards
        got = pack_vectors(vectors, shards, turn)
        assert got.tolist() == expected
        for column, most in ((0, 0.02), (1, 0.2), (2, 0.1)):
            sums = np.bincount(got, vectors[:, column], shards)
            assert abs(sums / capacity[column] - 1).max() < most


def test_tokens_are_balanced_whatever_stands_between_them(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([" ", "\n", "\t"]).join(["w" * rng.choice([1, 30])] * rng.randint(1, 60))) for k in range(3000)]
    placed = {r.doc_id: r.shard for r in vector_sharding(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sums = np.zeros(16)
    for k, text in rows:
        sums[placed[k]] += len(text.split())
    assert abs(sums / sums.mean() - 1).max() < 0.1


def kind(c: str) -> int:
    if "a" <= c <= "z" or "A" <= c <= "Z" or "0" <= c <= "9":
        return 0 if c.islower() else 1 if c.isupper() else 2
    if c in " \t":
        return 3
    if c in "\n\x0b\x0c\r":
        return 4
    return 5 if c in ".,;:'\"!?()-" else 7 if ord(c) > 127 else 6


def plain_distance(p, q):
    total, other = sum(p), sum(q)
    if not total or not other:
        return 0.0
    out = 0.0
    for a, b in zip(p, q):
        a, b = a / total, b / other
        m = (a + b) / 2
        out += sum(x * math.log2(x / m) for x in (a, b) if x) / 2
    return math.sqrt(max(0, out))


def test_distances_and_verdicts_equal_plain_ones(spark):
    rng = random.Random(7)
    spoken = {"en": ["the", "of", "river", "boat", "and", "in", "house"], "de": ["der", "und", "haus", "die", "fluss", "in", "boot"]}
    rows = [(k, " ".join(rng.choice(spoken[lang]).capitalize() if rng.random() < 0.1 else rng.choice(spoken[lang]) for _ in range(rng.randint(5, 90))) + rng.choice([".", "!\n", "é"]), lang)
            for k, lang in ((k, rng.choice(["en", "de"])) for k in range(160))]
    rows += [(900 + k, "%$ 12 #& " * (20 + k), "en") for k in range(4)] + [(950, "Ω ж " * 60, "xx"), (951, None, "en"), (952, "", None), (953, " ".join(f"w{k}" for k in range(60)), "de")]
    limits = QualityLimits(reference_docs=10, reference_words=300)
    words = re.compile(r"[^\x20\x09-\x0D]+")
    spelled = {w: k for k, x in enumerate(WORDS) for w in (x, x.capitalize())}
    chars, common, failed = {}, {}, {}
    for i, text, _ in rows:
        found = words.findall(text or "")
        chars[i], common[i] = [0] * 8, [0] * (len(WORDS) + 1)
        for c in text or "":
            chars[i][kind(c)] += 1
        for w in found:
            common[i][spelled.get(w, len(WORDS))] += 1
        windows = [tuple(found[k:k + 5]) for k in range(len(found) - 4)]
        covered = {j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(k, k + 5)}
        failed[i] = len(found) < 10 or 100 * len(covered) > 20 * len(found)
    reference = {}
    for lang in ("en", "de", "xx"):
        mine = [i for i, _, x in rows if x == lang and not failed[i]]
        counts = [sum(common[i][k] for i in mine) for k in range(len(WORDS) + 1)]
        if len(mine) >= 10 and sum(counts) >= 300:
            reference[lang] = ([sum(chars[i][k] for i in mine) for k in range(8)], counts)
    assert set(reference) == {"en", "de"}
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), limits).collect()}
    for i, _, lang in rows:
        far = [plain_distance(own, ref) for own, ref in zip((chars[i], common[i]), reference.get(lang, ([], [])))] if lang in reference else [0.0, 0.0]
        assert got[i].base_failed == failed[i] and got[i].char_distance == pytest.approx(far[0], abs=1e-9) and got[i].word_distance == pytest.approx(far[1], abs=1e-9)
        odd = far[0] > limits.chars_distance and sum(chars[i]) >= limits.chars_from or far[1] > limits.words_distance and sum(common[i]) >= limits.words_from
        assert got[i].kept == (not failed[i] and not odd)
    assert sum(not failed[i] and not got[i].kept for i, _, _ in rows) >= 1 and got[950].char_distance == 0.0
    kept = {r.doc_id for r in good_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string"), limits).collect()}
    assert kept == {i for i, r in got.items() if r.kept}


def test_distance_of_nothing():
    assert distance(np.array([[0, 0], [1, 1]]), np.array([0, 0])).tolist() == [0.0, 0.0]
    assert distance(np.array([[0, 5], [5, 0]]), np.array([5, 0])) == pytest.approx([1.0, 0.0])


def test_every_labelled_text_is_fitted(spark):
    """A word that only texts of over 32 KB have, and more rows of a label than ``per_label``."""
    rng = random.Random(3)
    docs = [(k, " ".join(rng.choice(["ra", "ne", "to"]) + rng.choice("abc") for _ in range(8000 if k % 4 == 3 else 12)) + (" grobian" if k % 4 == 3 else ""), "en") for k in range(200)]
    labels = spark.createDataFrame([(k, int(k % 4 == 3)) for k, _, _ in docs], "doc_id long, toxic int")
    frame = spark.createDataFrame(docs + [(900, "ra grobian", "en"), (901, "ra ne", "en")], "doc_id long, text string, lang string")
    model, limits = fit_toxicity(frame, labels, 5, 0, TextCnnParams(bits=12, per_label=2, max_bytes=100))
    fitted = {r.word for r in word_counts(frame.filter("doc_id < 200").withColumn("label", F.lit(1))).collect()}
    assert {w for w in model.print.view(np.int64).tolist() if w} == fitted and len(fitted) == 10
    scores = {r.doc_id: r.score for r in score_toxicity(frame, model).collect()}
    assert scores[900] > 0.5 > scores[901] and set(limits) == {"en"}
    again, _ = fit_toxicity(frame.repartition(7), labels.repartition(3), 5, 0, TextCnnParams(bits=12))
    assert np.array_equal(again.emb, model.emb) and again.base == model.base


def test_sketches_are_subtracted_not_sets(spark):
    """A digest that is twice in one sketch and once in the other is left once."""
    pairs = spark.createDataFrame([(1, 0, [7, 7, 8], [7, 9]), (2, 0, [5], [5])], "row long, pair int, a array<long>, b array<long>").repartition("row")
    assert {tuple(r) for r in recovered_digests(pairs, "row").collect()} == {(1, 0, 7, 1), (1, 0, 8, 1), (1, 0, 9, -1)}
    near = {r.row: (r.near, r.peeled) for r in likeness(pairs, "row").collect()}
    assert near == {1: (0.25, True), 2: (1.0, True)}
