from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from argusframe.llm.spelling import SpellingParams, one_edit, padded, spelling_groups

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def one_apart(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain(rows) -> set[tuple]:
    counts: Counter = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [x for x in words if one_apart(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def variant_rows():
    """Words with chains of variants, long ones, letters beyond ASCII and a group that many share."""
    rng = random.Random(5)
    letters = "abcdeéñÿ"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(60)] + ["prefix" + "".join(rng.choice("ab") for _ in range(5)) for _ in range(40)]
    words += ["long" * 900, "long" * 900 + "x", "straße", "STRASSE", "strasse", "Ärger", "ärger"]
    for w in list(words[:80]):
        at = rng.randrange(len(w))
        words += [w[:at] + w[at + 1:], w[:at] + rng.choice(letters) + w[at:], w[:at] + "z" + w[at + 1:]]
    rows = []
    for k in range(150):
        rows.append((k, " ".join(w for w in rng.choices(words, k=70)) + " 1x2 don't\n"))
    for k, w in enumerate(["longer", "longert", "longerta", "longertas"]):
        rows.append((900 + k, f"{w}-" * 3 * 3 ** k))
    return rows + [(None, "nobody nobody nobody nobodi nobodi nobodi nobodi nobodi nobodi"), (500, None), (501, ""), (501, " "), rows[0], rows[0]]


@pytest.mark.parametrize("params", [SpellingParams(), SpellingParams(tile_bytes=100, pair_bytes=2000)])
def test_groups_equal_plain_search(spark, params):
    rows = variant_rows()
    docs = spark.createDataFrame([(d, t, "w", 1, "n") for d, t in rows], "doc_id long, text string, word string, n int, form string").repartition(3)
    got = [tuple(r) for r in spelling_groups(docs, params).select(*COLUMNS).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain(rows)
    assert any(r[2] not in (r[0], r[1]) for r in got)  # a chain of forms


def test_odd_rows(spark, odd_documents, odd_rows, no_documents):
    assert {tuple(r) for r in spelling_groups(odd_documents).select(*COLUMNS).collect()} == plain([(r[0], r[1]) for r in odd_rows])
    assert spelling_groups(no_documents).count() == 0
    assert spelling_groups(odd_documents.filter("text IS NULL")).count() == 0


@given(st.lists(st.text("abé\U0001F600", min_size=1, max_size=7), min_size=2, max_size=8))
def test_prefix_and_suffix_tell_single_edits(words):
    lengths = np.array([len(w) for w in words])
    left, right = padded(words, lengths)
    a, b = np.triu_indices(len(words), 1)
    prefix, near = one_edit(left, right, lengths, a, b)
    assert near.tolist() == [one_apart(words[i], words[j]) for i, j in zip(a, b)]
    assert prefix.tolist() == [next((k for k, (x, y) in enumerate(zip(words[i], words[j])) if x != y), min(len(words[i]), len(words[j]))) for i, j in zip(a, b)]
