"""Spelling variants: words one edit apart, by generating the full neighbourhood of every word.

All distinct deletions, replacements and insertions over the alphabet of the
vocabulary are made and hash-joined to the vocabulary; a match is a near word,
so no distance is computed. Made first are the neighbours' hashes, as sums of
parts of the word's own, and a bitmap of the vocabulary's hashes drops those
that cannot be words before their texts are made and shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage
from .url_filter import LOWER, UPPER

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, TIMES, DROP_EVERY = 7, 2, 10, 31
#: The bitmap has about this many bits for each word, and 2 ** MOST_BITS at most: with more words it lets more through, never less.
BITS_PER_WORD, MOST_BITS, TESTS = 24, 28, 3
BLOCK = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_MASK = 2**64 - 1


def words(documents: DataFrame, *, least_length: int = LEAST_LENGTH, drop_every: int = DROP_EVERY) -> DataFrame:
    """word: a row for each run of letters of at least ``least_length``, A-Z in lower case.

    Of a run whose crc32 with its document's id is divisible by
    ``drop_every``, one letter is left out (``drop_every`` 0: of none). A null
    id counts as an empty one.
    """
    runs = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))).alias("run"))
    runs = runs.withColumn("run", F.translate("run", UPPER, LOWER))
    if not drop_every:
        return runs.select(F.col("run").alias("word"))
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    made = runs.select("run", h.alias("h")).select(F.when(F.col("h") % drop_every == 0, cut).otherwise(F.col("run")).alias("word"))
    return made.filter(F.length("word") >= least_length)


def vocabulary(words_: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n for words that occur ``least_count`` times; counted before any shuffle."""
    return words_.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


class Hashes:
    """Hashes of texts as sums over places: code(letter) * base ** place, modulo 2 ** 64."""

    def __init__(self, alphabet: np.ndarray) -> None:
        self.alphabet = np.asarray(alphabet, np.uint32)
        self.inverse = np.uint64(pow(_BASE, -1, 2**64))

    @staticmethod
    def codes(points: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            return x ^ (x >> np.uint64(32))

    @staticmethod
    def powers(n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n - 1, 0), np.uint64(_BASE)), dtype=np.uint64)])[:n]

    def of(self, points: np.ndarray) -> np.ndarray:
        """The hash of each row of code points."""
        with np.errstate(over="ignore"):
            return (self.codes(points) * self.powers(points.shape[1])).sum(1, dtype=np.uint64)


def places(h: np.ndarray, bits: int, test: int) -> np.ndarray:
    """Where the bitmap has a bit for each hash."""
    with np.errstate(over="ignore"):
        x = (h ^ (h >> np.uint64(31))) * np.uint64((0xD6E8FEB86659FD93 * (2 * test + 1)) & _MASK)
        return x >> np.uint64(64 - bits)


def matrix(texts: list[str], length: int) -> np.ndarray:
    """Texts of one length as rows of code points."""
    return np.array(texts, dtype=f"<U{length}").view(np.uint32).reshape(len(texts), length)


def neighbours(texts: list[str], hashes: Hashes, bitmap: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, list[str]]]:
    """For words of one length: numbers of words, and a neighbour of each whose hash the bitmap has.

    Each neighbour of a word comes once: a letter is left out at the first
    place of its run, and put in where the letter before is another one.
    """
    length = len(texts[0])
    step = max(1, BLOCK // max(1, min(length + 1, BLOCK) * len(hashes.alphabet)))
    span = max(1, BLOCK // len(hashes.alphabet))  # places at once, for very long words

    def kept(h: np.ndarray) -> tuple[np.ndarray, ...]:
        flat = h.reshape(-1)
        at = np.arange(len(flat))
        for test in range(TESTS):
            p = places(flat[at] if test else flat, bits, test)
            at = at[(bitmap[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1]
        return np.unravel_index(at, h.shape)

    letters = hashes.codes(hashes.alphabet)
    powers = hashes.powers(length + 1)
    with np.errstate(over="ignore"):
        for start in range(0, len(texts), step):
            points = matrix(texts[start:start + step], length)
            parts = hashes.codes(points) * powers[:length]
            before = np.concatenate([np.zeros((len(points), 1), np.uint64), np.cumsum(parts, 1, dtype=np.uint64)], 1)
            whole = before[:, -1:]
            for a in range(0, length + 1, span):
                b = min(a + span, length + 1)
                d = min(b, length)
                if a < d:
                    first = np.concatenate([np.ones((len(points), 1), bool), points[:, 1:] != points[:, :-1]], 1)[:, a:d]
                    row, i = kept(before[:, a:d] + (whole - before[:, a + 1:d + 1]) * hashes.inverse)
                    ok = first[row, i]
                    yield from _texts(start, points, row[ok], i[ok] + a, None)
                    row, i, c = kept((whole - parts[:, a:d])[:, :, None] + letters * powers[a:d, None])
                    ok = points[row, i + a] != hashes.alphabet[c]
                    yield from _texts(start, points, row[ok], i[ok] + a, hashes.alphabet[c[ok]], replace=True)
                row, i, c = kept((before[:, a:b] + (whole - before[:, a:b]) * np.uint64(_BASE))[:, :, None] + letters * powers[a:b, None])
                i = i + a
                ok = (i == 0) | (points[row, np.maximum(i - 1, 0)] != hashes.alphabet[c])
                yield from _texts(start, points, row[ok], i[ok], hashes.alphabet[c[ok]])


def _texts(start: int, points: np.ndarray, row: np.ndarray, at: np.ndarray, letter: np.ndarray | None, replace: bool = False) -> Iterator[tuple[np.ndarray, list[str]]]:
    """The neighbours' texts, some at a time."""
    length = points.shape[1]
    wide = length + (0 if replace else -1 if letter is None else 1)
    if not wide:  # the empty text is no word
        return
    some = max(1, (1 << 20) // wide)
    for x in range(0, len(row), some):
        r, i = row[x:x + some], at[x:x + some, None]
        if replace:
            made = points[r]
            made[np.arange(len(r)), i[:, 0]] = letter[x:x + some]
        else:
            to = np.arange(wide)[None, :]
            made = np.take_along_axis(points[r], np.minimum(to + (to >= i) if letter is None else np.maximum(to - (to > i), 0), length - 1), 1)
            if letter is not None:
                made[np.arange(len(r)), i[:, 0]] = letter[x:x + some]
        yield start + r, np.ascontiguousarray(made).view(f"<U{wide}").reshape(-1).tolist()


def near_pairs(vocabulary_: DataFrame) -> DataFrame:
    """word, n, near, near_n for all pairs of words one edit apart, both ways. ``vocabulary_`` (word, n) is a staged table of distinct words."""
    spark = vocabulary_.sparkSession
    size = vocabulary_.count()
    # the letters of the vocabulary: a few of those that the words are made of
    letters = [r[0] for r in vocabulary_.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c <> ''").distinct().collect()]
    if not letters:
        return vocabulary_.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    hashes = Hashes(np.array(sorted(map(ord, letters)), np.uint32))
    bits = max(15, min(MOST_BITS, (size * BITS_PER_WORD).bit_length()))

    def marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for length, some in pdf.groupby(pdf["word"].str.len())["word"]:
                block = max(1, BLOCK // int(length))
                for at in range(0, len(some), block):
                    h = hashes.of(matrix(some.iloc[at:at + block].tolist(), int(length)))
                    yield pd.DataFrame({"at": np.concatenate([places(h, bits, t) for t in range(TESTS)]).astype(np.int64)})

    pages = vocabulary_.select("word").mapInPandas(marks, "at long").groupBy(F.expr("at DIV 32768").alias("page")).agg(F.bitmap_construct_agg(F.expr("at % 32768")).alias("bits"))
    bitmap = np.zeros(1 << (bits - 3), np.uint8)  # 32 MB at most
    for page, data in pages.collect():
        bitmap[page * 4096:(page + 1) * 4096] = np.frombuffer(bytes(data), np.uint8)
    shared = spark.sparkContext.broadcast(bitmap)

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, some in pdf.groupby(pdf["word"].str.len()):
                texts, counts = some["word"].to_numpy(object), some["n"].to_numpy()
                for at, near in neighbours(texts.tolist(), hashes, shared.value, bits):
                    yield pd.DataFrame({"word": texts[at], "n": counts[at], "near": near})

    candidates = vocabulary_.mapInPandas(made, "word string, n long, near string")
    return candidates.join(vocabulary_.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """word, root for rows of word, form (not null): forms are followed to the last one.

    A form occurs several times as often as its word, so the way is short and
    is halved in each round.
    """
    links = stage(forms.select("word", F.col("form").alias("root")), "spelling-links")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = stage(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-links")
        if links.filter("moved").isEmpty():
            return links.select("word", "root")


def variants(documents: DataFrame, *, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES, drop_every: int = DROP_EVERY) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of at least ``least_length`` letters and ``least_count`` occurrences.

    ``documents`` has doc_id and text; other columns are ignored. Null texts
    have no words; whole texts are read. Two words are near if one letter put
    in, left out or replaced makes one of the other. A word's form is its near
    word of largest n, if that is at least ``times`` the word's; ties go to
    the smaller word in code-point order. ``root`` follows forms to the last,
    and is the word itself without one. An empty table gives an empty result.
    """
    counted = stage(vocabulary(words(documents, least_length=least_length, drop_every=drop_every), least_count), "spelling-words")
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near")))
    near = near_pairs(counted).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    fit = F.col("best.near_n") >= times * F.col("n")
    known = stage(near.select("word", "n_near", F.when(fit, F.col("best.near")).alias("form"), F.when(fit, F.col("best.near_n")).alias("form_n")), "spelling-forms")
    ends = roots(known.filter("form IS NOT NULL"))
    out = counted.join(known, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("form_n").cast("long").alias("form_n"))
