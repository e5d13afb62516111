"""SentencePiece encoding and decoding for merge-type (BPE) models.

A string is encoded by backtracking: an Aho-Corasick automaton gives the pieces that match at each place, the
longest are tried first, and a piece is accepted after another if merging the two again from single characters
gives just these two. Places from which no way leads to the end are remembered in a bit field. A sequence of
pieces whose neighbours all pass is the one that merging the whole string gives.

Texts are cut where no piece can reach across (before a space mark, around characters that are no piece, between
a letter and a punctuation mark that no piece joins), so that strings are short and repeat; results are cached
up to a bound in each Python worker.
"""

from __future__ import annotations

import hashlib
import re
import struct
import sys
from array import array
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class PieceCodec:
    """Encoder and decoder of one model file; ``limit`` bounds each cache."""

    def __init__(self, path: str, limit: int = 600_000):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.limit, self.bos, self.eos = limit, model.bos_id(), model.eos_id()
        self.bytes, self.ids, self.scores, self.raw_byte = [], {}, {}, {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.raw_byte[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unused(i):
                self.bytes.append(b"")
            else:
                self.bytes.append(piece.replace(MARK, " ").encode())
                if not model.is_unknown(i):
                    self.ids[piece], self.scores[piece] = i, model.get_score(i)
        self.pieces = {i: p for p, i in self.ids.items()}
        self.machine = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.machine.add_word(piece, (len(piece), i))
        self.machine.make_automaton()
        if any(MARK in p.lstrip(MARK) for p in self.ids) or any(c not in self.ids for p in self.ids for c in p):
            raise ValueError("cutting at space marks and unknown characters needs pieces that don't cross them")
        self.letters = frozenset(c for c in self.ids if re.fullmatch(f"[{_LETTERS}]", c))
        self.known = re.compile("[" + "".join(re.escape(c) for c in self.ids if len(c) == 1) + "]+")
        joined = {p[k + 1] for p in self.ids for k in range(len(p) - 1) if p[k] in self.letters}
        self.tail = "".join(c for c in ".,;:!?|*$%&#" if c not in joined)
        self.cache: dict[str, bytes | None] = {}
        self.short: dict[str, bytes] = {}
        self.fits: dict[int, bool] = {}

    def merged(self, text: str) -> list[int]:
        """Plain merging from single characters: the best-scored pair first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                return [self.ids[p] for p in parts]
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= self.limit:
                self.fits.clear()
            known = self.fits[key] = self.merged(self.pieces[left] + self.pieces[right]) == [left, right]
        return known

    def backtrack(self, text: str) -> list[int]:
        """Pieces of a string of known characters."""
        i = self.ids.get(text)
        if i is not None and (len(text) == 1 or self.merged(text) == [i]):
            return [i]
        size = len(text)
        found: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]
        for end, match in self.machine.iter(text):
            found[end - match[0] + 1].append(match)
        failed, fits = 0, self.fits
        path: list[tuple[int, int, int]] = []  # start, piece, choices left
        start, choice, last = 0, len(found[0]), -1
        while start < size:
            options = found[start]
            while choice:
                choice -= 1
                length, i = options[choice]
                if failed >> (start + length) & 1:
                    continue
                if last >= 0:
                    fit = fits.get(last << 32 | i)
                    if not (self.compatible(last, i) if fit is None else fit):
                        continue
                path.append((start, i, choice))
                start += length
                choice, last = len(found[start]), i
                break
            else:
                failed |= 1 << start
                if not path:
                    return self.merged(text)
                start, _, choice = path.pop()
                last = path[-1][1] if path else -1
        return [i for _, i, _ in path]

    def _string(self, text: str) -> bytes:
        """Ids of a string without cuts known beforehand, as little-endian 32-bit integers."""
        out: list[int] = []
        at = 0
        for known in self.known.finditer(text):
            out += [self.raw_byte[b] for b in text[at:known.start()].encode()]
            out += self.backtrack(known.group())
            at = known.end()
        out += [self.raw_byte[b] for b in text[at:].encode()]
        return array("I", out).tobytes() if sys.byteorder == "little" else struct.pack(f"<{len(out)}I", *out)

    def _cached(self, text: str) -> bytes:
        ids = self.short.get(text)
        if ids is None:
            if len(self.short) >= self.limit:
                self.short.clear()
            ids = self.short[text] = self._string(text)
        return ids

    def _chunk(self, text: str) -> bytes:
        """Ids of a string that ends where no piece reaches across; marks after its last letter are cut off."""
        body = text.rstrip(self.tail)
        if body and len(body) < len(text) and body[-1] in self.letters:
            return self._cached(body) + self._cached(text[len(body):])
        return self._cached(text)

    def _word(self, word: str) -> bytes | None:
        """Ids of a word after a space, or of a line break (not a piece) and a word; None for the empty word."""
        if not word:
            return None
        if word[0] != "\n" or "\n" in self.ids:
            return self._chunk(MARK + word)
        return self._string("\n") + (self._chunk(word[1:]) if len(word) > 1 else b"")

    def encode(self, text: str) -> bytes:
        """Ids with begin and end as little-endian 32-bit integers."""
        body = b""
        if text:
            cache, odd, ids = self.cache, MARK in text, []
            for word in [] if odd else text.replace("\n", " \n").split(" "):
                got = cache.get(word)
                if got is None:
                    if len(cache) >= self.limit:
                        cache.clear()
                    got = self._word(word)
                    if got is None:
                        odd = True  # several spaces in a row: their marks may be one piece
                        break
                    cache[word] = got
                ids.append(got)
            body = b"".join([self._cached(x) for x in _CHUNK.findall(MARK + text.replace(" ", MARK))] if odd else ids)
        return struct.pack("<I", self.bos) + body + struct.pack("<I", self.eos)

    def decode(self, ids: bytes) -> str:
        table = self.bytes
        text = b"".join([table[i] for i in memoryview(ids).cast("I")]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    """One codec for each model file in a Python worker."""
    return PieceCodec(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): ids of each whole text with begin and end, and the text they decode to.

    A null text is encoded as the empty one; repeated rows come out alike; an empty table gives an empty result; only
    doc_id and text are read.
    """

    def run(batches):
        c = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [c.encode(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), pa.array([c.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, ids binary, decoded string")


def codec_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row; digests are taken next to the encoder."""

    def run(batches):
        c = codec(path)
        for batch in batches:
            ids = [c.encode(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                 pa.array([hashlib.sha256(c.decode(x).encode()).hexdigest() for x in ids])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
