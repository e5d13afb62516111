from __future__ import annotations

import random
import zlib

import pytest

from argusframe.llm.byte_cnn import ByteCnnParams, quality_classifier
from argusframe.llm.text_cnn import TextCnnParams, best_threshold, toxicity_classifier

SYLLABLES = ["ra", "ne", "to", "li", "mu", "se", "ko", "va"]


def sentence(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(6)
    docs, labels = [], []
    for k in range(700):
        quality, toxic = rng.random() < 0.7, rng.random() < 0.3
        text = sentence(rng, rng.randint(20, 200))
        if not quality:
            text = " ".join(w + "%%&" for w in text.split())
        if toxic:
            w = text.split()
            for _ in range(1 + len(w) // 30):
                w.insert(rng.randint(0, len(w)), rng.choice(["grobian", "schuft"]))
            text = " ".join(w)
        docs.append((k, text, rng.choice(["en", "de"]), "other"))
        if k % 10:
            labels.append((k, int(quality), int(toxic)))
    docs += [(900, None, None, "x"), (901, "", "en", "x"), (902, "é" * 50_000, "fr", "x"), docs[3]]
    labels += [(3, 0, 0), (None, 1, 1), (4, None, None)]
    return (spark.createDataFrame(docs, "doc_id bigint, text string, lang string, score string"),
            spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), {i: (q, t) for i, q, t in labels if i is not None and q is not None and i != 3})


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_held_out_accuracy(labelled, kind, spark):
    docs, labels, truth = labelled
    if kind == "quality":
        got, folds, out, limit = quality_classifier(docs, labels, params=ByteCnnParams(per_label=300)), 4, 2, 0.7
    else:
        got, folds, out, limit = toxicity_classifier(docs, labels, params=TextCnnParams(per_label=300)), 5, 0, 0.5
    rows = got.collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == out) and 0 <= r.score <= 1 and r.predicted == (r.score >= limit) for r in rows)
    judged = [r.predicted == truth[r.doc_id][kind == "toxic"] for r in rows if r.held_out and r.doc_id in truth]
    assert len(judged) > 80 and sum(judged) > 0.95 * len(judged)
    assert len({r.score for r in rows if r.doc_id == 3}) == 1
    assert len({r.score for r in rows if r.doc_id in (900, 901)}) == 1


def test_nothing_to_learn_or_score(labelled):
    docs, labels, _ = labelled
    for run in (quality_classifier, toxicity_classifier):
        assert run(docs.limit(0), labels).collect() == []
        assert run(docs, labels.limit(0)).count() == docs.count()


def test_thresholds():
    import numpy as np
    scores, truth = np.linspace(0, 1, 400), (np.linspace(0, 1, 400) > 0.7).astype(int)
    assert abs(best_threshold(scores, truth) - 0.7) < 0.051
    assert best_threshold(scores[:20], truth[:20]) == 0.5


def test_labels_are_never_broadcast(labelled):
    from argusframe.llm.labelled import labelled_rows
    docs, labels, truth = labelled
    rows = labelled_rows(docs, labels, "toxic", 5, 0)
    plan = rows._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    fitted = {i for i in truth if zlib.crc32(str(i).encode()) % 5}
    assert {r.doc_id for r in rows.collect()} == fitted
