from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from argusframe.llm.source_mix import MixParams, mix_counts, mix_sources, source_targets


def poured(sizes: dict, weights=(3, 1, 2), share=1.5, most=2.0) -> dict:
    """Targets by giving what is over to the rest, round after round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, full = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in full]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if most * sizes[s] < weight[s] * level]
        if not over:
            return {**full, **{s: min(most * sizes[s], weight[s] * level) for s in open_}}
        for s in over:
            full[s] = most * sizes[s]
            left -= full[s]


def plain(rows) -> Counter:
    sized = [(d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, s in rows]
    sums: dict = {}
    for _, s, n in sized:
        sums[s] = sums.get(s, 0) + n
    targets, out = poured(sums), Counter()
    digest = lambda x: hashlib.md5(f"12:{'' if x is None else x}".encode()).hexdigest()
    for s in sums:
        rate, at = (targets[s] / sums[s] if sums[s] else 0.0), int(digest(s)[:13], 16) / 16 ** 13
        for k, (d, n) in enumerate(sorted(((d, n) for d, x, n in sized if x == s), key=lambda r: (r[1], digest(r[0])))):
            copies = min(2, math.floor((k + 1) * rate + at) - math.floor(k * rate + at))
            out[(d, n, sums[s], targets[s], copies * n)] += 1
    return out


def mixed_rows():
    rng = random.Random(3)
    rows = [(k, " ".join(["w"] * rng.randint(1, 400)), rng.choice(["big"] * 20 + ["small", "tiny", None, "Zed"])) for k in range(900)]
    return rows + [(2000, None, "empty"), (2001, "", "empty"), (2002, " \n\t", None), (None, "a b c", "big"), (2003, "x " * 40000, "huge"), rows[5], rows[5]]


def test_equal_to_plain_sampling(spark):
    rows = mixed_rows()
    docs = spark.createDataFrame([(d, t, s, "k", 1, "c") for d, t, s in rows], "doc_id long, text string, source string, keep string, size int, rank string").repartition(5)
    got = [tuple(r) for r in mix_counts(docs).collect()]
    assert Counter(got) == plain(rows)
    assert Counter(tuple(r) for r in mix_counts(docs.repartition(2, "text")).collect()) == Counter(got)
    assert all(0 <= taken <= 2 * size for _, size, _, _, taken in got)
    by_target: dict = {}
    for _, size, total, target, taken in got:
        x = by_target.setdefault((total, target), [0, 0])
        x[0], x[1] = x[0] + taken, max(x[1], size)
    assert all(abs(taken - target) <= longest for (_, target), (taken, longest) in by_target.items())
    assert abs(sum(t for _, t in by_target) - 1.5 * sum(n for n, _ in by_target)) < 1e-6


def test_mix_has_whole_rows(spark):
    rows = mixed_rows()[:200]
    docs = spark.createDataFrame([(d, t, s, d, "c") for d, t, s in rows], "doc_id long, text string, source string, copies long, stratum string")
    mix = mix_sources(docs)
    assert mix.columns == docs.columns
    taken = Counter(r.doc_id for r in mix.collect())
    assert {r.doc_id: r.taken for r in mix_counts(docs).collect() if r.taken} == {d: taken[d] * len(t.split()) for d, t, _ in rows if d in taken}
    assert set(map(tuple, mix.collect())) <= set(map(tuple, docs.collect()))


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 1, "b": 1000, "c": 5, None: 7}, {"a": 0, "b": 0}, {"a": 100, "b": 1, "c": 1, "d": 1, "e": 50}, {f"s{k:02d}": 3 ** (k % 9) for k in range(40)}])
def test_targets(spark, sizes):
    got = {r.source: r.target for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    assert got == pytest.approx(poured(sizes))


def test_odd_rows(spark, odd_documents, odd_rows, no_documents):
    assert mix_counts(no_documents).count() == 0 and mix_sources(no_documents).count() == 0
    assert Counter(tuple(r) for r in mix_counts(odd_documents).collect()) == plain([(r[0], r[1], r[3]) for r in odd_rows])
    other = MixParams(seed=4)
    assert sorted(map(tuple, mix_counts(odd_documents, other).collect()), key=repr) != sorted(map(tuple, mix_counts(odd_documents).collect()), key=repr)
