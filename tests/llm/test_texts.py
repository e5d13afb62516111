from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from argusframe.llm.packing import CAPACITY, TokenEncoder, best_fit_packing, best_fit_plan
from argusframe.llm.piece_codec import PieceCodec, codec_digests, encode_documents
from argusframe.llm.quality_rules import good_documents, quality_rules
from argusframe.llm.sanitize import sanitize, sanitize_digests
from argusframe.llm.sharding import vector_sharding
from argusframe.llm.sketches import document_fingerprints

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
SCRAPS = ["a", "b", " ", "  ", "\n", "\t", "é", "漢", "▁", "😀", ".", ",", "Hello", "ing", "\x00", "the", "0", "12", "     ", "x.y", "\r\n", "!!", "'s", "\x1c", " ", "<|endoftext|>"]
MIXED = st.lists(st.sampled_from(SCRAPS), max_size=40).map("".join)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES), PieceCodec(PIECES, limit=500), TokenEncoder(BYTES, limit=500), Tokenizer.from_file(BYTES)


@settings(max_examples=400, deadline=None)
@given(MIXED | st.text(max_size=40))
def test_codecs_equal_the_libraries(library, text):
    pieces, own, tokens, bpe = library
    expected = pieces.encode(text, add_bos=True, add_eos=True)
    ids = own.encode(text)
    assert list(memoryview(ids).cast("I")) == expected
    assert own.decode(ids) == pieces.decode(expected)
    assert list(memoryview(tokens.encode(text)).cast("I")) == bpe.encode(text, add_special_tokens=False).ids


def test_long_runs(library):
    pieces, own, _, _ = library
    for text in [" " * k + "w" + " " * j for k in range(0, 40, 3) for j in (0, 1, 17)] + ["a" * 3000, "ab" * 1500]:
        assert list(memoryview(own.encode(text)).cast("I")) == pieces.encode(text, add_bos=True, add_eos=True)


def test_piece_queries(odd_documents, odd_rows, no_documents, library):
    pieces = library[0]
    originals = {r[0]: r[1] or "" for r in odd_rows}
    got = codec_digests(odd_documents, PIECES).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        ids = pieces.encode(originals[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(pieces.decode(ids).encode()).hexdigest()
    assert {r.doc_id: r.decoded for r in encode_documents(odd_documents, PIECES).collect()} == originals
    assert codec_digests(no_documents, PIECES).collect() == []


def test_plan_is_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(200):
        capacity = rng.choice([1, 10, 16, 50])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 150))]
        plan = best_fit_plan(dict(Counter(lengths)), capacity)
        by_length, ranks, bins = defaultdict(list), Counter(), defaultdict(list)
        for length, rank, sequence, offset in plan.tolist():
            by_length[length].append((rank, sequence, offset))
        for rows in by_length.values():
            rows.sort()
        for length in lengths:
            rank, sequence, offset = [x for x in by_length[length] if x[0] <= ranks[length]][-1]
            bins[sequence + ranks[length] - rank].append((offset, length))
            ranks[length] += 1
        rooms = []  # one by one, tightest room first
        for length in sorted(lengths, reverse=True):
            at = bisect_left(rooms, length)
            insort(rooms, (capacity if at == len(rooms) else rooms.pop(at)) - length)
        for rows in bins.values():
            rows.sort()
            assert [o for o, _ in rows] == [sum(n for _, n in rows[:k]) for k in range(len(rows))]
        assert sorted(capacity - sum(n for _, n in rows) for rows in bins.values()) == rooms


def test_packing(odd_documents, odd_rows, no_documents, library):
    bpe = library[3]
    got = best_fit_packing(odd_documents, BYTES, with_ids=True).collect()
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and len(r.ids) == 4 * r.length
    for rows in bins.values():
        rows.sort()
        assert rows[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(rows, rows[1:])) and sum(n for _, n in rows) <= CAPACITY
    copies = Counter(r[0] for r in odd_rows)
    for i, text in {r[0]: r[1] for r in odd_rows}.items():
        ids = [*bpe.encode(text or "", add_special_tokens=False).ids, 0]
        rows = sorted(by_doc[i], key=lambda r: r.piece)[::copies[i]]
        assert [r.start for r in rows] == [0, *range((len(ids) - 1) % CAPACITY + 1, len(ids), CAPACITY)]
        assert b"".join(bytes(r.ids) for r in rows) == np.array(ids, "<u4").tobytes()
    assert best_fit_packing(no_documents, BYTES).collect() == []


def test_sharding(odd_documents, odd_rows, no_documents, spark):
    got = vector_sharding(odd_documents).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in odd_rows)
    originals = {r[0]: (r[1] or "").encode() for r in odd_rows}
    slots = defaultdict(list)
    for r in got:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(originals[r.doc_id]) + 1, zlib.crc32(originals[r.doc_id]), "bytes", None)
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert vector_sharding(no_documents).collect() == []
    hot = spark.range(3000).selectExpr("id AS doc_id", "IF(id < 1000, 'the very same text', repeat(CAST(id AS STRING), 1 + CAST(id % 40 AS INT))) AS text")
    rows = vector_sharding(hot, chunk_groups=1000).groupBy("shard").agg({"size": "sum", "doc_id": "count"}).collect()
    sizes = [r["sum(size)"] for r in rows]
    assert len(rows) == 16 and max(sizes) < 1.03 * min(sizes)


def plain_measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    counts, covered, lines, doubles = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4)), set(), set(), 0
    for k in range(len(w) - 4):
        if counts[tuple(w[k:k + 5])] > 1:
            covered.update(range(k, k + 5))
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            doubles += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), doubles, len(covered)


def test_quality_rules(odd_documents, odd_rows, no_documents):
    got = quality_rules(odd_documents).collect()
    assert len(got) == len(odd_rows)
    originals = {r[0]: r[1] for r in odd_rows}
    for r in got:
        m = plain_measures(originals[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m
        assert r.base_failed == (m[0] < 10 or 100 * m[4] > 20 * m[0])
        assert not (r.base_failed and r.kept)
    good = good_documents(odd_documents)
    assert good.columns == odd_documents.columns
    assert Counter(r.doc_id for r in good.collect()) == Counter(r.doc_id for r in got if r.kept)
    assert quality_rules(no_documents).collect() == [] and good_documents(no_documents).collect() == []


def test_odd_distributions_are_rejected(spark):
    rng = random.Random(3)
    fair = ["the", "of", "and", "house", "river", "walks", "slowly", "under", "a", "grey", "sky", "to", "in"]
    rows = [(k, " ".join(rng.choice(fair) + str(rng.randint(0, 99)) * (rng.random() < .02) for _ in range(150)), "en") for k in range(60)]
    rows.append((900, " ".join(f"{rng.choice('QXZ')}{rng.randint(0, 9999)}!!%%" for _ in range(150)), "en"))
    rows.append((901, "!!%% QXZ9 9999", "en"))
    kept = {r.doc_id: r.kept for r in quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert all(kept[k] for k in range(60)) and not kept[900] and not kept[901]


def test_languages_in_any_spelling_have_references_of_their_own(spark):
    rng = random.Random(4)
    fair = {"en": ["the", "of", "and", "house", "river", "walks", "slowly", "under"], "ru": ["дом", "река", "идёт", "медленно", "под", "небом"], "sr": ["kuća", "reka", "ide", "polako"]}

    def text(code):
        return " ".join(rng.choice(fair[code]) for _ in range(150)) if code in fair else "".join(rng.choice("的一是在不了有和人這中大為上個") + " " * (k % 9 == 8) for k in range(900))

    spelled = [(f"en-{x}", "en") for x in ("US", "GB", "us")] * 20 + [("EN", "en")] * 10 + [("ru-RU", "ru"), ("RU", "ru"), ("zh-CN", "zh"), ("zh_Hant", "zh"), ("sr-Latn", "sr"), ("sr_Cyrl", "ru")] * 2
    spelled += [(x, lang) for x in (None, "", "und", "??", "unknown") for lang in ("en", "ru", "zh")]
    junk = " ".join(f"{rng.choice('QXZ')}{rng.randint(0, 9999)}!!%%" for _ in range(150))
    rows = [(k, text(lang), code) for k, (code, lang) in enumerate(spelled)] + [(900, junk, "EN-us"), (901, "too short", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    assert [(k, spelled[k]) for k in range(len(spelled)) if not got[k].base_failed and not got[k].kept] == []
    assert got[900].char_distance > 0.29 and not got[900].kept and not got[901].kept
    assert all(got[k].char_distance == got[k].word_distance == 0 for k, (code, _) in enumerate(spelled) if code in (None, "", "und", "??", "unknown"))
    assert {r.doc_id for r in good_documents(docs).collect()} == {i for i, r in got.items() if r.kept}


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for o, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0
            if (kind == "ip" and max(map(int, m.group().split("."))) > 255 or kind == "card" and not (12 <= len(digits) <= 19 and luhn)
                    or kind == "phone" and not 9 <= len(digits) <= 15):
                continue
            out.append((m.start(), o, m.end(), kind))
    return sorted(out)


def test_sanitize(spark, odd_documents, odd_rows, no_documents):
    rng = random.Random(5)
    scraps = ["a", "b.c", "@", "x@y.z", "1", "4111 1111 1111 1111", "4111-1111-1111-1111", " ", "-", ".", "+", "+1 (415) 555-2671", "192.168.0.1", "256.1.1.1", "0001.2.3.4", "\n", "é", "😀", "u@mail.example.com", "12", "_", "%", "(", "9.9.9"]
    rows = [(k, "".join(rng.choice(scraps) for _ in range(rng.randint(0, 25)))) for k in range(600)]
    rows += [(1001, "a" * 20000 + "@"), (1002, "1" * 20000), (1003, "x@" + "a." * 20000), (1004, "+" + "1." * 20000), (1005, None)]
    for docs, source in ((spark.createDataFrame(rows, "doc_id bigint, text string"), rows), (odd_documents, odd_rows)):
        originals = {r[0]: r[1] or "" for r in source}
        got = sanitize_digests(docs).collect()
        assert len(got) == len(source)
        for r in got:
            base = plain_spans(originals[r.doc_id])
            assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in base).encode()).hexdigest()
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == o for x in base) for o in range(4)]
    assert sanitize_digests(no_documents).collect() == [] and sanitize(no_documents).collect() == []
    out = sanitize(odd_documents)
    assert out.columns == odd_documents.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    originals = {r[0]: r[1] for r in odd_rows}
    for i, text in originals.items():
        if not plain_spans(text or ""):
            assert texts[i] == text
    assert "mail me [EMAIL] or [PHONE] now" in texts.values() and "host [IP] card [CARD] end" in texts.values()


def test_terms_that_give_an_entity_away(spark):
    rows = [(k, f"notes on rivers number{k} and more words") for k in range(40)]
    rows += [(100 + k, f"the agent Quillfeather writes from q@mail.example.com about rivers {k}") for k in range(3)]
    rows += [(200, "elsewhere Quillfeather is not named with an address"), (201, "once Solitary wrote from s@mail.example.com today")]
    got = {r.doc_id: r.spans for r in sanitize_digests(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    start = rows[40][1].index("Quillfeather")
    assert f"term:{start}:{start + len('Quillfeather')}" in got[100]
    assert "rivers" not in [rows[40][1][int(a):int(b)] for k, a, b in (x.split(":") for x in got[100].split(","))]
    assert got[200] == "" and "term" not in got[201]


def plain_terms(texts, support=2, disclosure=0.8):
    """Spans of revealing terms of each text, with all counts made again over the different texts."""
    import regex
    texts = sorted(set(texts))
    blank, entities = {}, {}
    for text in texts:
        spans, cut = plain_spans(text), list(text)
        for s, _, e, _ in spans:
            cut[s:e] = " " * (e - s)
        blank[text] = "".join(cut)
        entities[text] = {(o, text[s:e].lower() if o == 0 else re.sub("[^0-9.]", "", text[s:e])) for s, o, e, _ in spans}
    runs = {text: [(m.start(), m.end(), m.group().lower()) for m in regex.finditer(r"[\p{L}\p{M}\p{N}]+", blank[text])] for text in texts}
    n_t = Counter(t for text in texts for t in {r[2] for r in runs[text]})
    n_e = Counter(e for text in texts for e in entities[text])
    n_et = Counter((e, t) for text in texts for e in entities[text] for t in {r[2] for r in runs[text]})
    reveals = set()
    for (e, t), n in n_et.items():
        if n >= support and np.log2(len(texts) * n / (n_t[t] * n_e[e])) >= disclosure * np.log2(len(texts) / min(len(texts) / 2, n_e[e])) - 1e-12:
            reveals.add((e, t))
    return {text: {(s, f) for s, f, t in runs[text] if any((e, t) in reveals for e in entities[text])} for text in texts}


def test_statistics_equal_a_recount_and_copies_are_no_evidence(spark):
    rng = random.Random(12)
    names, common = [f"name{k}" for k in range(12)], [f"word{k}" for k in range(30)]
    rows = []
    for k in range(260):
        text = rng.choices(common, k=rng.randint(3, 12))
        if k % 4 == 0:
            who = rng.randrange(8)
            text[1:1] = [names[who], f"{'abcdefgh'[who]}@mail.example.com"]
        if k % 9 == 0:
            text.append(rng.choice(names))
        rows.append((k, " ".join(text)))
    rows += [(900, "two copies only hold this zebra x@twice.example.com"), (901, "two copies only hold this zebra x@twice.example.com"), (902, None)]
    expected = plain_terms([t or "" for _, t in rows])
    assert sum(map(len, expected.values())) > 20

    def got(rows):
        out = sanitize_digests(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
        return {r.doc_id: {(int(s), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x) if k == "term"} for r in out}, {(r.doc_id, r.spans) for r in out}
    spans, printed = got(rows)
    assert spans == {d: expected[t or ""] for d, t in rows} and spans[900] == set()
    assert got(rows * 4)[1] == printed
    assert got(rows + [(5000 + d, t) for d, t in rows if d % 2])[0].items() >= spans.items()


def test_terms_count_and_go_over_whole_documents(spark):
    far = " and so it goes" * 12
    rows = [(k, f"notes on rivers number{k} and so it goes") for k in range(60)]
    rows += [(100 + k, f"(Wu-Li) met\tQuillfeather.{far} q@mail.example.com{far} quillfeather's boat {k}, Li") for k in range(3)]
    rows += [(200, "Quillfeather far from any address"), (300, "mail8 q@mail.example.com")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.spans for r in sanitize_digests(docs).collect()}
    text = rows[60][1]
    places = {(int(s), int(e)) for kind, s, e in (x.split(":") for x in got[100].split(",")) if kind == "term"}
    assert {text[s:e] for s, e in places} == {"Wu", "Li", "met", "Quillfeather", "quillfeather", "s", "boat"}
    assert sorted(s for s, e in places if text[s:e] == "Li") == [m.start() for m in re.finditer("Li", text)]
    cleaned = {r.doc_id: r.text for r in sanitize(docs).collect()}
    assert "feather" not in cleaned[101].lower() and "[EMAIL]" in cleaned[101] and "term" not in got[300]


def test_sketches(spark, odd_documents, odd_rows, no_documents):
    got = document_fingerprints(odd_documents).collect()
    assert len(got) == len(odd_rows)
    order = sorted(((r[0], r[1] or "") for r in odd_rows), key=lambda r: (-r[0], r[1]))
    expected = defaultdict(list)
    for k, (i, text) in enumerate(order):
        third = len(text) // 3
        expected[i].append(hashlib.sha256((text[:len(text) - third] + order[(k + 1) % len(order)][1][:third]).encode()).hexdigest())
    prints = defaultdict(set)
    originals = dict(order)
    for r in got:
        assert r.edited_sha256 in expected[r.doc_id] and r.n_chars == len(originals[r.doc_id])
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints[originals[r.doc_id]].add(r.fingerprint)
    assert all(len(x) == 1 for x in prints.values())
    long = [r for r in got if r.n_chars >= 200]
    assert np.mean([r.near_edited for r in long]) > 0.3
    assert document_fingerprints(no_documents).collect() == []
    one = document_fingerprints(spark.createDataFrame([(1, "abc " * 100)], "doc_id bigint, text string")).first()
    assert one.near_next == 1.0


def hashed(key, seeds=()):
    """Spark's xxhash64 of a long and then of ints."""
    h = xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42)
    for j in seeds:
        h = xxhash.xxh64_intdigest(struct.pack("<i", j), seed=h)
    return h


def cells_of(key, w):
    return [(hashed(key, (j,)) & (w - 1)) + j * w for j in range(3)]


def sketch_of(keys, w):
    """Cells (n, k, c) of digests, by place."""
    out = {}
    for key in keys:
        for cell in cells_of(key, w):
            n, k, c = out.get(cell, (0, 0, 0))
            out[cell] = (n + 1, k ^ key, c ^ hashed(key))
    return out


def parsed(fingerprint):
    raw = base64.b64decode(fingerprint)
    n, w = struct.unpack(">II", raw[:8])
    cells = {}
    for at in range(8, len(raw), 17):
        k, c = struct.unpack(">qI", raw[at + 5:at + 17])
        cells[int.from_bytes(raw[at:at + 3], "big")] = (int.from_bytes(raw[at + 3:at + 5], "big"), k, c)
    return n, w, cells


def folded(cells, w, narrow):
    out = {}
    for cell, (n, k, c) in cells.items():
        at = cell // w * narrow + cell % w % narrow
        m, l, d = out.get(at, (0, 0, 0))
        out[at] = (n + m, k ^ l, c ^ d)
    return out


def plain_near(a, b):
    """The likeness of two printed fingerprints, from them alone."""
    (na, wa, a), (nb, wb, b) = parsed(a), parsed(b)
    if na + nb == 0:
        return 1.0, True
    least = min(wa, wb)
    for w in (max(8, least // 4), least):
        left, right = folded(a, wa, w), folded(b, wb, w)
        cells = {}
        for at in {*left, *right}:
            (n, k, c), (m, l, d) = left.get(at, (0, 0, 0)), right.get(at, (0, 0, 0))
            if (n - m, k ^ l, c ^ d) != (0, 0, 0):
                cells[at] = (n - m, k ^ l, c ^ d)
        used = len(cells)
        if used > 0.91 * 3 * w:
            continue
        found = 0
        for step in range(18):
            table = step % 3
            singles = [(n, k) for at, (n, k, c) in cells.items() if at // w == table and abs(n) == 1 and hashed(k) & 0xFFFFFFFF == c and cells_of(k, w)[table] == at]
            found += len(singles)
            for n, k in singles:
                for at in cells_of(k, w):
                    m, l, d = cells.get(at, (0, 0, 0))
                    cells[at] = (m - n, l ^ k, d ^ (hashed(k) & 0xFFFFFFFF))
                    if cells[at] == (0, 0, 0):
                        del cells[at]
        if not cells:
            return (na + nb - found) / (na + nb + found), True
    guess = int(-w * math.log(max(0.5, 3 * w - used) / (3 * w)) + 0.5)
    d = min(na + nb, max(abs(na - nb), guess))
    return (na + nb - d) / (na + nb + d), False


def edits():
    """Texts of five lengths with three edits each."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    signs = [chr(0x4E00 + rng.randint(0, 800)) for _ in range(4000)]
    rows = []
    for n, units, gap in ((160, words, " "), (190, words, " "), (9000, words, " "), (11000, words, " "), (900, signs, "")):
        text = [rng.choice(units) for _ in range(n)]
        other, third = [rng.choice(units) for _ in range(n // 3)], n - n // 3
        edits = {"first": ["new", *text], "third": text[:third] + other, "words": [f"x{k}" if k % 2500 == 100 else u for k, u in enumerate(text)]}
        rows += [(len(rows) + j, n, name, gap.join(text), gap.join(e)) for j, (name, e) in enumerate(edits.items())]
    return rows


def test_paragraphs_are_of_one_size_whatever_the_length(spark):
    from pyspark.sql import functions as F

    from argusframe.llm.sketches import likeness, paragraph_digests, recovered_digests
    df = spark.createDataFrame(edits(), "row int, n int, name string, a string, b string")
    keyed = df.select("row", F.lit(0).alias("pair"), "n", "name", F.length("a").alias("chars"), F.expr(paragraph_digests("a")).alias("a"), F.expr(paragraph_digests("b")).alias("b")).cache()
    near = {r.row: r for r in likeness(keyed.repartition("row"), "row").collect()}
    found = defaultdict(set)
    for r in recovered_digests(keyed.repartition("row"), "row").collect():
        found[r.row].add((r.digest, r.sign))
    for r in keyed.collect():
        assert 5 < r.chars / len(r.a) < 250
        exact = len({*r.a} & {*r.b}) / len({*r.a, *r.b})
        if near[r.row].peeled:
            assert abs(near[r.row].near - exact) < 1e-12
            assert found[r.row] == {(k, 1) for k in {*r.a} - {*r.b}} | {(k, -1) for k in {*r.b} - {*r.a}}
        else:
            assert r.n < 1000 and r.row not in found
        assert (0.2 if r.n < 1000 else 0.4) < exact < 0.7 if r.name == "third" else exact > (0.6 if r.n < 1000 else 0.95), r
    assert sum(r.peeled for r in near.values()) >= 13


def test_likeness_comes_from_the_fingerprints_alone(spark):
    from pyspark.sql import functions as F
    texts = [t for r in edits() if r[2] != "third" for t in (r[3], r[4])]
    rows = [(k, t) for k, t in enumerate([*texts, *texts[:3], "", None, "one line", "a\nb\nc", "a\nb\nd", " ".join(texts[0].split()[:40])])]
    got = document_fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).orderBy(F.col("doc_id").desc()).collect()
    peeled = 0
    for r, after in zip(got, [*got[1:], got[0]]):
        near, sure = plain_near(r.fingerprint, r.edited_fingerprint)
        assert abs(near - r.near_edited) < 1e-12
        peeled += sure
        assert abs(plain_near(r.fingerprint, after.fingerprint)[0] - r.near_next) < 1e-12
    assert peeled > 0.8 * len(got)


def test_printed_cells_and_peeling(spark):
    from pyspark.sql import functions as F

    from argusframe.llm.sketches import fingerprints, likeness, recovered_digests
    rng = random.Random(8)
    rows = []
    for k in range(120):
        both, a, b = ([rng.getrandbits(64) - (1 << 63) for _ in range(rng.randint(0, n))] for n in (rng.choice([3, 30, 300]), 30, 20))
        rows.append((k, 0, both + a, both + b))
    df = spark.createDataFrame(rows, "row int, pair int, a array<bigint>, b array<bigint>").repartition("row").cache()
    prints = {r.row: (r.a, r.b) for r in fingerprints(df, "row", ("a", "b")).collect()}
    near = {r.row: r for r in likeness(df, "row").collect()}
    digests = recovered_digests(df, "row").groupBy("row").agg(F.collect_set(F.struct("digest", "sign")).alias("d"))
    found = {r.row: {(x.digest, x.sign) for x in r.d} for r in digests.collect()}
    for k, _, a, b in rows:
        for keys, fingerprint in zip((a, b), prints[k]):
            n, w, cells = parsed(fingerprint)
            assert n == len(keys) and w == max(8, 1 << max(0, math.ceil(math.log2(max(1, n) / 2))))
            assert cells == {at: (n, x, c & 0xFFFFFFFF) for at, (n, x, c) in sketch_of(keys, w).items()}
        assert (near[k].near, near[k].peeled) == plain_near(*prints[k])
        if near[k].peeled:
            assert near[k].near == (len({*a} & {*b}) / len({*a, *b}) if a or b else 1)
            assert found.get(k, set()) == {(x, 1) for x in {*a} - {*b}} | {(x, -1) for x in {*b} - {*a}}
        else:
            assert k not in found
    assert sum(r.peeled for r in near.values()) > 60


def test_few_windows_are_sent_for_near_copies(spark):
    from argusframe.llm.substring_dedup import repeated_windows, substring_dedup_digests
    words = [f"word{k}" for k in range(400)]
    edited = words[:150] + ["other"] + words[151:]
    again = words[100:130] + ["x"] + words[:60] * 2
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate([words, edited, words, again])], "doc_id bigint, text string")
    _, cuts = repeated_windows(docs)
    assert sum(len(r.cuts) for r in cuts.collect()) < 100  # of about 850 windows that occur earlier
    removed = {r.doc_id: r.n_removed for r in substring_dedup_digests(docs).collect()}
    assert removed == {0: 0, 1: 399, 2: 400, 3: 150}
