"""Quality rules by distribution divergence.

Two histograms of a document, over classes of characters and over common words,
are held against those of its language by the Jensen-Shannon distance (square
root of the divergence in bits, 0 to 1). The references are sums over all
documents of the language that pass the base rules; nothing is sampled. Each
language (and script, where the code names one) has its own reference, and where
the language is not known only the base rules judge. Short
documents say little about a distribution, so each distance counts only from a
minimum length on.

The counting runs in Arrow batches next to the scan; what is shuffled is one row
of sums for each batch and language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argusframe.llm.textbatch import Slice, mix, slices, windows

# Symbols counted by the base rules and frequent words of four languages.
SYMBOLS = "#*$%&|<>"
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "a", "in", "is", "it", "that", "was", "for", "on", "are", "with", "as", "be", "this", "at", "by", "from"),
    "de": ("der", "die", "und", "das", "den", "von", "zu", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "plus", "pas", "au", "sur"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al"),
}
WORDS = tuple(sorted({w for ws in COMMON_WORDS.values() for w in ws}))
CLASSES = ("lower", "upper", "digit", "blank", "break", "stop", "symbol", "beyond ascii")


@dataclass(frozen=True)
class QualityLimits:
    """Limits of the rules. ``min_words``, ``max_repeat`` (percent) are the base; ``*_from`` are the
    lengths from which a distance counts, ``*_distance`` the largest that is kept; ``reference_*`` are the documents and words a language needs
    for a reference."""

    min_words: int = 10
    max_repeat: int = 20
    chars_from: int = 100
    chars_distance: float = 0.29
    words_from: int = 50
    words_distance: float = 0.40
    reference_docs: int = 20
    reference_words: int = 2000


def _class_table() -> np.ndarray:
    table = np.full(256, 6, np.int8)
    for first, last, kind in (("a", "z", 0), ("A", "Z", 1), ("0", "9", 2)):
        table[ord(first):ord(last) + 1] = kind
    table[[0x20, 0x09]] = 3
    table[0x0A:0x0E] = 4
    for c in ".,;:'\"!?()-":
        table[ord(c)] = 5
    table[0x80:0xC0] = 8  # later bytes of a character are not counted
    table[0xC0:] = 7
    return table


_CLASS = _class_table()
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in SYMBOLS])


def _word_keys() -> tuple[np.ndarray, np.ndarray]:
    """Sorted fingerprints of the common words as written in lower case and with a capital, and the number of each."""
    spelled = [*WORDS, *(w.capitalize() for w in WORDS)]
    keys = np.concatenate([s.words for s in slices(pa.array(spelled))])
    order = np.argsort(keys)
    return keys[order], (np.arange(len(keys)) % len(WORDS))[order]


_KEYS, _NUMBER = _word_keys()


#: Codes that name no language: undetermined, several, not coded, no linguistic content.
NO_LANGUAGE = ("und", "mul", "mis", "zxx")


def language(code: str | None) -> str:
    """The language of a code in any spelling (en-US, EN, zh_Hant, en_GB.UTF-8): its primary part and its script in small letters, "" if not known."""
    parts = re.split("[-_.@]", (code or "").strip().lower())
    if not re.fullmatch("[a-z]{2,3}", parts[0]) or parts[0] in NO_LANGUAGE:
        return ""
    return "-".join([parts[0], *(x for x in parts[1:2] if re.fullmatch("[a-z]{4}", x))])


def measure(s: Slice) -> dict[str, np.ndarray]:
    """Counts of each text of a slice; ``chars`` and ``common`` have a column for each class and word (the last: other words)."""
    n_words = np.diff(s.word_bounds)
    text_of_word = np.repeat(np.arange(s.n), n_words)

    repeated = np.zeros(len(s.words) + 1, np.int64)
    hashed = windows(s.words, 5)
    if len(hashed):
        own = text_of_word[:len(hashed)]
        whole = np.flatnonzero(own == text_of_word[4:])
        starts = whole[_repeats(mix(hashed[whole] + own[whole].astype(np.uint64)))]
        np.add.at(repeated, starts, 1)
        np.add.at(repeated, starts + 5, -1)
    n_repeat = np.bincount(text_of_word[np.cumsum(repeated[:-1]) > 0], minlength=s.n)

    starts, ends, owner = s.lines()
    worded = np.searchsorted(s.starts, ends) > np.searchsorted(s.starts, starts)
    owner, keys = owner[worded], mix(s.hashes(starts[worded], ends[worded]) + owner[worded].astype(np.uint64))
    first = np.zeros(len(keys), bool)
    first[np.unique(keys, return_index=True)[1]] = True
    n_dup = np.bincount(owner[~first], minlength=s.n)

    kinds = _CLASS[s.data].astype(np.int64)
    text_of_byte = np.repeat(np.arange(s.n), np.diff(s.bounds))
    chars = np.bincount(text_of_byte * 9 + kinds, minlength=s.n * 9).reshape(s.n, 9)[:, :8]

    at = np.minimum(np.searchsorted(_KEYS, s.words), len(_KEYS) - 1)
    number = np.where(_KEYS[at] == s.words, _NUMBER[at], len(WORDS)) if len(at) else at
    common = np.bincount(text_of_word * (len(WORDS) + 1) + number, minlength=s.n * (len(WORDS) + 1)).reshape(s.n, -1)
    return {"n_words": n_words, "word_chars": s.counts(s.inside & (s.data & 0xC0 != 0x80)), "n_symbols": s.counts(_SYMBOL[s.data]),
            "n_dup_lines": n_dup, "n_repeat_words": n_repeat, "chars": chars, "common": common}


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _base_failed(m: dict[str, np.ndarray], limits: QualityLimits) -> np.ndarray:
    return (m["n_words"] < limits.min_words) | (100 * m["n_repeat_words"] > limits.max_repeat * m["n_words"])


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts p to the counts q; 0 where either has none."""
    some = (p.sum(1) > 0) & (q.sum() > 0)
    p = p / np.maximum(p.sum(1, keepdims=True), 1)
    q = q / max(q.sum(), 1)
    middle = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / middle), 0).sum(1)
        right = np.where(q > 0, q * np.log2(q / middle), 0).sum(1)
    return np.where(some, np.sqrt(np.maximum((left + right) / 2, 0)), 0.0)


def references(docs: DataFrame, limits: QualityLimits) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Summed histograms of each language over all its documents that pass the base rules; a language with too few documents or words has none."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for s in slices(batch.column("text")):
                m = measure(s)
                both = np.concatenate([m["chars"], m["common"]], 1)
                good = ~_base_failed(m, limits)
                own = np.array([language(x) for x in langs[s.first:s.first + s.n]])
                both = np.concatenate([both, np.ones((s.n, 1), np.int64)], 1)
                for code in np.unique(own[good & (own != "")]):
                    totals[code] = totals.get(code, 0) + both[good & (own == code)].sum(0)
        if totals:
            yield pa.RecordBatch.from_pydict({"lang": list(totals), "counts": [x.tolist() for x in totals.values()]},
                                             schema=pa.schema([("lang", pa.string()), ("counts", pa.list_(pa.int64()))]))

    parts = docs.select("text", "lang").mapInArrow(sums, "lang string, counts array<bigint>")
    width = len(CLASSES) + len(WORDS) + 2
    total = parts.groupBy("lang").agg(F.array(*[F.sum(F.col("counts")[k]) for k in range(width)]).alias("counts"))
    found = {r.lang: (np.array(r.counts[:len(CLASSES)]), np.array(r.counts[len(CLASSES):-1]), r.counts[-1]) for r in total.collect()}
    return {code: (chars, words) for code, (chars, words, n) in found.items() if n >= limits.reference_docs and words.sum() >= limits.reference_words}


def _verdicts(batch: pa.RecordBatch, limits: QualityLimits, known: dict) -> Iterator[tuple[Slice, dict[str, np.ndarray]]]:
    """Measures and verdict of the rows of a batch, slice by slice."""
    langs = batch.column("lang").to_pylist()
    for s in slices(batch.column("text")):
        m = measure(s)
        own = np.array([language(x) for x in langs[s.first:s.first + s.n]])
        m["char_distance"], m["word_distance"] = np.zeros(s.n), np.zeros(s.n)
        for code in np.unique(own):
            if code in known:
                mine = own == code
                m["char_distance"][mine] = distance(m["chars"][mine], known[code][0])
                m["word_distance"][mine] = distance(m["common"][mine], known[code][1])
        odd = (m["char_distance"] > limits.chars_distance) & (m["chars"].sum(1) >= limits.chars_from)
        odd |= (m["word_distance"] > limits.words_distance) & (m["n_words"] >= limits.words_from)
        m["base_failed"] = _base_failed(m, limits)
        m["kept"] = ~m["base_failed"] & ~odd
        yield s, m


def quality_rules(docs: DataFrame, limits: QualityLimits | None = None) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance, kept) for each row of ``docs``.

    Null or blank texts have no words and fail the base; where the language code is null or names no
    language, or one with fewer than ``reference_docs`` documents or ``reference_words`` words, the distances are 0 and only the base rules judge;
    repeated rows are judged one by one and alike; an empty table gives an empty result; columns other than
    doc_id, text and lang are not looked at.
    """
    limits = limits or QualityLimits()
    known = references(docs, limits)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rest = ("base_failed", "char_distance", "word_distance", "kept")

    def judge(batches):
        for batch in batches:
            for s, m in _verdicts(batch, limits, known):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(s.first, s.n), *(pa.array(m[k].astype(np.int64)) for k in counts), *(pa.array(m[k]) for k in rest)],
                                                 names=["doc_id", *counts, *rest])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").mapInArrow(
        judge, f"doc_id bigint, {' bigint, '.join(counts)} bigint, base_failed boolean, char_distance double, word_distance double, kept boolean")


def good_documents(docs: DataFrame, limits: QualityLimits | None = None) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, in one pass next to the scan."""
    limits = limits or QualityLimits()
    known = references(docs, limits)

    def keep(batches):
        for batch in batches:
            kept = [m["kept"] for _, m in _verdicts(batch, limits, known)]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(keep, docs.schema)
