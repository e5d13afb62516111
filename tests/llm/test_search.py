from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from argusframe.llm.lexical_search import Plan, SearchParams, accumulate, impacts, lexical_search, share

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def plain(docs, items, top=20):
    read = [(d, Counter(terms(t))) for d, t in docs]
    read = [(d, c, sum(c.values())) for d, c in read if c]
    documents, words = len(read), sum(n for _, _, n in read)
    df = Counter(t for _, c, _ in read for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for d, c, n in read:
            m = 75 + 25 * n * documents // words
            score = sum(q * math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t, q in Counter(terms(text)).items() if c[t])
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item, k + 1, None if gone else d, -s) for k, (s, gone, d) in enumerate(sorted(scores)[:top])]
    return Counter(out)


def corpus():
    rng = random.Random(8)
    vocabulary = [f"{a}{b}" for a in "abé中" for b in ("x", "Y", "7", "long" * 20, "\U0001F600")]
    make = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", "-", "\n", "_", "!"]) for _ in range(n))
    docs = [(k, make(rng.randint(1, 60))) for k in range(150)] + [(k, make(4)) for k in range(200, 260)]
    docs += [(300, None), (301, ""), (302, "--- !!"), (None, "ax ax aY"), (303, "ax " * 20000), docs[3], docs[3], (3, "other text of one id ax")]
    items = [(k, make(rng.randint(1, 25))) for k in range(40)] + [(90, None), (91, ""), (92, "nowhere at all"), (93, "ax"), (93, "aY aY"), (93, "ax"), (94, "AX ax")]
    return docs, items


@pytest.mark.parametrize("params", [SearchParams(), SearchParams(plan_items=7, mined=3, pass_terms=100, matrix_bytes=4000)])
def test_equal_to_plain_ranking(spark, params):
    docs, items = corpus()
    d = spark.createDataFrame([(a, b, "t", 1, 2) for a, b in docs], "doc_id long, text string, term string, rank int, n int").repartition(4)
    i = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, item int").repartition(2)
    assert Counter(tuple(r) for r in lexical_search(d, i, params).select("item_id", "rank", "doc_id", "score").collect()) == plain(docs, items)


def test_odd_rows(spark, odd_documents, odd_rows, no_documents):
    items = [("a", "w1 w2 w3 mail one"), ("b", "again goes here"), (None, "w1")]
    frame = spark.createDataFrame(items, "item_id string, text string")
    assert Counter(tuple(r) for r in lexical_search(odd_documents, frame).collect()) == plain([(r[0], r[1]) for r in odd_rows], items)
    assert lexical_search(no_documents, frame).count() == 0
    assert lexical_search(odd_documents, frame.filter("item_id = 'c'")).count() == 0
    assert lexical_search(odd_documents, frame).columns == lexical_search(no_documents, frame).columns


@given(st.lists(st.dictionaries(st.integers(0, 12), st.integers(1, 3), max_size=9), min_size=1, max_size=8), st.integers(1, 12))
def test_plans_add_up(items, mined):
    counts = {k: Counter(x) for k, x in enumerate(items)}
    plan = share(counts, mined)
    value = np.array([10 ** (t % 6) + t for t in plan.terms], np.int64)
    got = accumulate(plan, np.arange(len(value)), np.zeros(len(value), np.int64), value, 1)
    assert got[:, 0].tolist() == [sum(q * (10 ** (t % 6) + t) for t, q in counts[k].items()) for k in plan.items]


def test_shared_sets_are_made_once():
    items = {k: Counter(range(10)) + Counter([20 + k]) for k in range(30)}
    plan = share(items, 256)
    assert len(plan.sums) == 9 and all(len(r) == 2 for r in plan.roots)
    assert isinstance(plan, Plan) and plan.size == 40 + 9


def test_impacts_of_long_documents():
    assert impacts(np.array([3]), np.array([10 ** 9]), 10 ** 11, 10 ** 13).tolist() == [3 * 10 ** 9 // (3000 + 12 * (75 + 25 * 10 ** 20 // 10 ** 13))]
