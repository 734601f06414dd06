"""Encoding and decoding with a SentencePiece vocabulary.

The pieces form an Aho-Corasick automaton. One pass over a text reports, at
each position, every piece that ends there (the automaton follows its output
links), and each relaxes the best score of that position: Viterbi over the
whole vocabulary without trying lengths. Characters in no piece become byte
pieces, at a price under any piece's.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import release

SPACE = "▁"
CACHE_WORDS, CACHED_LENGTH = 100_000, 64


def read_model(path: str) -> list[tuple[str, float, str]]:
    """(piece, score, kind) by id; kind is piece, byte, or other (control and unknown)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "piece"
    return [(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())]


class Codec:
    """Encoder and decoder for one vocabulary; built once for each worker."""

    def __init__(self, pieces: list[tuple[str, float, str]]):
        import ahocorasick

        self.pieces = pieces
        self.automaton = ahocorasick.Automaton()
        used = [(p, s, i) for i, (p, s, k) in enumerate(pieces) if k == "piece" and p]
        for p, s, i in used:
            self.automaton.add_word(p, (len(p), s, i))
        if used:
            self.automaton.make_automaton()
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == "byte"}
        self.unknown = next((i for i, (p, _, k) in enumerate(pieces) if k == "other" and p == "<unk>"), 0)
        self.low = min((s for _, s, _ in used), default=0.0) - 10.0
        self.raw = [bytes([int(p[3:5], 16)]) if k == "byte" else p.replace(SPACE, " ").encode() if k == "piece" else b"" for p, _, k in pieces]
        # Where no piece spans the border between a word and the blank after it, words are independent.
        joined = any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _, _ in used)
        inner = set().union(*(set(p) for p, _, _ in used if len(p) > 1)) if used else set()
        alone = "".join(re.escape(c) for c in map(chr, range(128)) if c not in inner)
        single = f"[{alone}]" if alone else r"(?!)"
        self.words = None if joined else re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+|{single}")
        self.cache = _Cache(self)

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best segmentation of ``text`` (blanks already written as U+2581, no literal one in it).

        Equal scores: the piece that starts first, so the longest.
        """
        n = len(text)
        best = [0.0] * (n + 1)
        came = [(0, -1)] * (n + 1)
        done = 0  # best[:done + 1] is final
        low = self.low

        def fill(to: int) -> None:
            for j in range(done + 1, to + 1):
                best[j] = best[j - 1] + low
                came[j] = (j - 1, -1)

        if self.pieces and len(self.automaton):
            for end, (size, score, i) in self.automaton.iter(text):
                end += 1
                if end > done:
                    fill(end)
                    done = end
                    # the byte way to this position has been entered; pieces must beat it
                new = best[end - size] + score
                if new > best[end] or (new == best[end] and came[end][1] >= 0 and end - size < came[end][0]):
                    best[end] = new
                    came[end] = (end - size, i)
        fill(n)
        ids: list[int] = []
        at = n
        while at:
            start, i = came[at]
            if i >= 0:
                ids.append(i)
            else:
                ids += self._as_bytes(text[start:at])[::-1]
            at = start
        return ids[::-1]

    def _as_bytes(self, c: str) -> list[int]:
        return [self.bytes.get(b, self.unknown) for b in c.replace(SPACE, " ").encode("utf-8", "surrogatepass")]

    def _plain(self, text: str) -> bytes:
        text = SPACE + text.replace(" ", SPACE)
        if self.words is None:
            return array("i", self.viterbi(text)).tobytes()
        return b"".join(map(self.cache.__getitem__, self.words.findall(text)))

    def encode(self, text: str) -> bytes:
        """Ids as 32-bit integers in sequence. The empty text has none.

        A literal U+2581 is written as bytes, so that decoding gives it back.
        """
        if not text:
            return b""
        if SPACE not in text:
            return self._plain(text)
        mark = array("i", [self.bytes.get(b, self.unknown) for b in SPACE.encode()]).tobytes()
        first, *rest = text.split(SPACE)
        out = [self._plain(first) if first else array("i", self.viterbi(SPACE)).tobytes()]
        for part in rest:
            out.append(mark)
            if part:
                part = part.replace(" ", SPACE)
                out.append(array("i", self.viterbi(part)).tobytes() if self.words is None else b"".join(map(self.cache.__getitem__, self.words.findall(part))))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        out = b"".join(map(self.raw.__getitem__, array("i", ids)))
        return out[1:].decode("utf-8", "replace")  # without the blank put before the first word


class _Cache(dict):
    """Words already seen by this worker, bounded in number and length."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, word: str) -> bytes:
        ids = array("i", self.codec.viterbi(word)).tobytes()
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids


def encode(docs: DataFrame, model: str, *, with_ids: bool = True) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_tokens, ids_sha256, round_trip[, ids].

    Needs ``doc_id`` and ``text``; other columns are ignored, whatever their
    names. A null text counts as empty: no tokens. ``round_trip`` says whether
    decoding gave the text back. The driver reads the vocabulary (a file of
    fixed size, whatever the corpus) and sends it to the workers. Repeated
    rows each give their row; an empty table gives an empty result.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(read_model(model))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(pieces.value)
        for pdf in batches:
            # a batch at a time can be many texts: their ids go out in parts
            for at in range(0, len(pdf), 100):
                part = pdf.iloc[at:at + 100]
                texts = [t or "" for t in part["text"]]
                ids = [codec.encode(t) for t in texts]
                out = pd.DataFrame({
                    "doc_id": part["doc_id"].array, "n_tokens": [len(x) // 4 for x in ids],
                    "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                    "round_trip": [codec.decode(x) == t for x, t in zip(ids, texts)],
                })
                if with_ids:
                    out["ids"] = [np.frombuffer(x, np.intc) for x in ids]
                yield out
        del codec
        release()

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text for rows of doc_id, ids; null ids give a null text, null or unknown ids in a list are skipped."""
    pieces = encoded.sparkSession.sparkContext.broadcast(read_model(model))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(pieces.value)
        n = len(codec.raw)
        for pdf in batches:
            texts = [None if x is None else codec.decode(array("i", [int(i) for i in x if i is not None and i == i and 0 <= i < n]).tobytes()) for x in pdf["ids"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].array, "text": texts})

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInPandas(run, "doc_id long, text string")
