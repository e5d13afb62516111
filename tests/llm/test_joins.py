from __future__ import annotations

import hashlib
import re
from collections import defaultdict

from argusframe.llm.ngram_join import ngram_jaccard_join, one_of_each_group
from argusframe.llm.substring_dedup import substring_dedup, substring_dedup_digests

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = WORD.findall((text or "").translate(SMALL))
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def components(rows):
    sets = {r[0]: shingle_set(r[1]) for r in rows}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_join_equals_brute_force(odd_documents, odd_rows):
    expected = components(odd_rows)
    got = ngram_jaccard_join(odd_documents).collect()
    assert len(got) == len(odd_rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert any(i != c for i, (_, c) in expected.items())
    kept = one_of_each_group(odd_documents)
    assert kept.columns == odd_documents.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, c in expected.values()}


def test_join_in_a_chain_and_a_dense_group(spark):
    base = [f"b{k}" for k in range(100)]
    rows = []
    for k in range(40):  # each text drifts by one word: neighbours link, ends don't
        base[k * 2] = f"new{k}"
        rows.append((k, " ".join(base)))
    rows += [(100 + k, " ".join([*(f"c{j}" for j in range(80)), f"tail{k}"])) for k in range(60)]
    got = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components(rows)


def test_join_of_nothing(no_documents, spark):
    assert ngram_jaccard_join(no_documents).collect() == []
    blank = spark.createDataFrame([(1, None), (2, ""), (None, "a b")], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, r.n_shingles) for r in ngram_jaccard_join(blank).collect()) == [(0, 1), (1, 0), (2, 0)]


def cut(rows):
    seen, out = {}, {}
    for i, text in sorted({(r[0], r[1]) for r in rows}, key=lambda r: r[0]):
        w, gone = WORD.findall(text or ""), set()
        for k in range(len(w) - 19):
            if seen.setdefault(tuple(w[k:k + 20]), (i, k)) != (i, k):
                gone.update(range(k, k + 20))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def test_substrings_equal_brute_force(odd_documents, odd_rows):
    expected = cut(odd_rows)
    got = substring_dedup_digests(odd_documents).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        n, gone, text = expected[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, hashlib.sha256(text.encode()).hexdigest())
    assert sum(g for _, g, _ in expected.values()) > 100
    texts = defaultdict(set)
    out = substring_dedup(odd_documents)
    assert out.columns == odd_documents.columns
    for r in out.collect():
        texts[r.doc_id].add(r.text)
    originals = {r[0]: r[1] for r in odd_rows}
    for i, (_, gone, text) in expected.items():
        assert texts[i] == ({text} if gone else {originals[i]})


def test_passage_repeated_inside_a_text_and_overlapping(spark):
    run = " ".join(f"p{k}" for k in range(25))
    rows = [(5, f"{run} x {run} y"), (7, " ".join(["z"] * 60)), (8, " ".join(["z"] * 30))]
    got = {r.doc_id: r for r in substring_dedup_digests(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    expected = cut(rows)
    assert {i: (r.n_words, r.n_removed) for i, r in got.items()} == {i: v[:2] for i, v in expected.items()}


def test_one_id_with_several_texts(spark):
    """Each text keeps its own cuts, whatever the other texts of its id are."""
    long, short = " ".join(f"a{k}" for k in range(80)), " ".join(f"b{k}" for k in range(30))
    rows = [(1, long), (2, long), (2, short), (3, short), (3, short), (4, "x " + short), (4, None), (4, "few words")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup_digests(docs).collect())
    assert got == [(1, 80, 0), (2, 30, 0), (2, 80, 80), (3, 30, 30), (3, 30, 30), (4, 0, 0), (4, 2, 0), (4, 31, 30)]
    assert sorted((r.doc_id, r.text or "") for r in substring_dedup(docs).collect()) == [(1, long), (2, ""), (2, short), (3, ""), (3, ""), (4, ""), (4, "few words"), (4, "x")]


def test_substrings_of_nothing(no_documents):
    assert substring_dedup_digests(no_documents).collect() == []
    assert substring_dedup(no_documents).collect() == []
