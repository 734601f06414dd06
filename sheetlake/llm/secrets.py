"""Secrets: patterns, and guess-cost dynamic programming over credential-context values.

The cost of a value is the least number of bits with which a guesser reaches
it when it may be cut into common words, dates, repeats, keyboard walks and
brute-force spans. A value in a credential context that no cheap segmentation
covers is a secret, whatever its keyword.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans at the same place are listed.
KINDS = ("assign", "access", "hex", "guess")


ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of [0-9a-f]+ of 32 characters and more
#: Credential contexts: a name with one of these words in it, a separator, and a value up to a blank or quote.
#: A try begins at the start of a name only, so long names stay linear.
CONTEXT = re.compile(
    r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]*?(?ai:password|passwd|passphrase|passcode|pwd|secret|token|credential|apikey|api_key|api-key|access_key|private_key|bearer|authorization))"
    r"[A-Za-z0-9_-]++[\"']?\x20*+(?::=|=>|[:=])\x20*+(?:(?:[Bb]earer|[Bb]asic)\x20)?[\"'`]?([^\s\"'`<>,;]+)"
)
STEMS = ("pass", "pwd", "secret", "token", "credential", "api", "access_key", "private_key", "bearer", "authorization")

#: Frequent passwords and words in them, most frequent first.
COMMON = (
    "password 123456 12345678 qwerty abc123 letmein monkey dragon master login admin welcome sunshine princess football baseball shadow "
    "superman michael iloveyou trustno1 hello freedom whatever ninja secret token test testing user guest root default changeme example "
    "sample demo temp temporary love summer winter spring autumn monday friday january march april june july august october december "
    "orange apple banana purple yellow black white green blue red silver golden star tiger lion eagle hunter ranger soccer hockey killer "
    "pepper cookie cheese coffee chocolate computer internet server system service account access private public company office business "
    "money dollar bank house family friend mother father sister brother angel heart flower peace happy lucky magic power super mega ultra "
    "alpha beta gamma delta omega zero one two three four five six seven eight nine ten key keys value string null none true false your "
    "here enter insert replace placeholder dummy fake foobar foo bar baz lorem ipsum dolor pass word pwd api prod dev stage local database"
).split()
#: Rows of keys and of the alphabet, for walks in either direction.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "azertyuiop", "abcdefghijklmnopqrstuvwxyz", "1qaz", "2wsx", "3edc", "4rfv", "5tgb", "6yhn", "7ujm")
NEXT = {(a, b) for row in ROWS for r in (row, row[::-1]) for a, b in zip(r, r[1:])}
LEET = str.maketrans("@4301!5$7", "aaeoiisst")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:(?:19|20)\d\d|\d\d)")
SEGMENT_BITS = 1.0


def _char_bits(c: str) -> float:
    if c.isdigit():
        return math.log2(10)
    if c.isalpha() and c.isascii():
        return math.log2(26)
    return math.log2(33) if c.isascii() else 10.0


class _Starts:
    """Starts j of a segment that ends at i, for the least ``cost[j] + log2(i - j)``.

    Of two starts the later one wins at first, if at all, and the earlier one
    for good once it has caught up. So starts are a stack: one is taken off
    when the one below catches up, and never goes on when it could not win.
    """

    __slots__ = ("stack",)

    def __init__(self) -> None:
        self.stack: list[tuple[int, float, float]] = []  # start, cost, where the one below catches up

    def add(self, j: int, cost: float) -> None:
        stack = self.stack
        while stack:
            below, base, until = stack[-1]
            if cost <= base:
                stack.pop()
                continue
            r = 2.0 ** min(cost - base, 1000.0)
            meets = (r * j - below) / (r - 1) if r > 1 else math.inf
            if meets < until:
                stack.append((j, cost, meets))
                return
            stack.pop()
        stack.append((j, cost, math.inf))

    def least(self, i: int) -> float:
        stack = self.stack
        while len(stack) > 1 and i >= stack[-1][2]:
            stack.pop()
        return stack[-1][1] + math.log2(i - stack[-1][0]) if stack else math.inf


def ranks(words: Iterable[str]) -> dict[str, int]:
    """Ranks from 1 of words of three letters and more, in lower case; the first place of a word counts."""
    out: dict[str, int] = {}
    for w in words:
        if len(w) >= 3:
            out.setdefault(w.lower(), len(out) + 1)
    return out


RANK = ranks(COMMON)


def guess_bits(value: str, rank: dict[str, int] = RANK) -> float:
    """Bits of the cheapest segmentation; 0 for an empty value.

    Every segmentation counts: words of every place, and walks, runs, repeats
    of blocks of two to eight characters and dates from every start. The work
    grows with the length times the longest word, and not with its square.
    """
    n = len(value)
    low, plain = value.lower(), value.lower().translate(LEET)
    if len(low) != n:  # a character whose lower case is longer
        low = plain = value
    longest = max(map(len, rank), default=0)
    best = [0.0] + [math.inf] * n
    bits = [0.0]
    for c in value:
        bits.append(bits[-1] + _char_bits(c))
    walk = run = 0
    walks, runs = _Starts(), _Starts()
    period = [0] * 9
    blocks = [[_Starts() for _ in range(size)] for size in range(9)]
    for i in range(1, n + 1):
        c = value[i - 1]
        # brute force, one character more (the class of the character is all that the guesser knows)
        here = best[i - 1] + bits[i] - bits[i - 1]
        # words, plain or with digits for letters; capitals cost a bit
        for size in range(3, min(longest, i) + 1):
            piece = low[i - size:i]
            place = rank.get(piece)
            leet = 0.0
            if place is None and (place := rank.get(plain[i - size:i])) is not None:
                leet = 2.0
            if place is not None:
                case = 0.0 if value[i - size:i] == piece else 1.0 if value[i - size + 1:i] == piece[1:] else 3.0
                here = min(here, best[i - size] + math.log2(place + 1) + leet + case + SEGMENT_BITS)
        # keyboard walks and sequences of three keys or more
        if i > 1 and (low[i - 2], low[i - 1]) in NEXT:
            walk += 1
            if walk >= 2:
                walks.add(i - 3, best[i - 3])
                here = min(here, walks.least(i) + math.log2(47) + SEGMENT_BITS)
        else:
            walk, walks = 0, _Starts() if walks.stack else walks
        # one character repeated three times or more
        if i > 1 and c == value[i - 2]:
            run += 1
            if run >= 2:
                runs.add(i - 3, best[i - 3])
                here = min(here, runs.least(i) + _char_bits(c) + SEGMENT_BITS)
        else:
            run, runs = 0, _Starts() if runs.stack else runs
        # a block of two to eight characters repeated
        for size in range(2, min(8, i - 1) + 1):
            if c != value[i - 1 - size]:
                if period[size] >= size:
                    blocks[size] = [_Starts() for _ in range(size)]
                period[size] = 0
                continue
            period[size] += 1
            if period[size] >= size:
                starts = blocks[size][i % size]
                starts.add(i - 2 * size, best[i - 2 * size])
                here = min(here, starts.least(i) - math.log2(size) + bits[i] - bits[i - size] + SEGMENT_BITS)
        # dates
        for size in (4, 6, 7, 8, 9, 10):
            if i >= size and c.isdigit() and value[i - size].isdigit() and DATE.fullmatch(value, i - size, i):
                here = min(here, best[i - size] + math.log2(130 * (1 if size == 4 else 366)) + SEGMENT_BITS)
        best[i] = here
    return best[n]


def find_secrets(text: str, min_bits: float, bits: Callable[[str], float]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], float]:
    """(base spans, added spans, largest guess cost of a base assignment's value); spans are (start, kind, end)."""
    base, added, most = [], [], 0.0
    low = text.lower()
    if any(k in low for k in STEMS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 8:
                base.append((m.start(), 0, m.end()))
                most = max(most, bits(m[2]))
        for m in CONTEXT.finditer(text):
            value = m[1].rstrip(".")
            if len(value) >= 8 and bits(value) >= min_bits:
                added.append((m.start(1), 3, m.start(1) + len(value)))
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    return base, _apart(added, base), most


def _apart(added: list, base: list) -> list:
    """Spans of ``added`` that touch none of ``base``, by one sweep."""
    out, i, reach = [], 0, -1
    for s, k, e in sorted(added):
        while i < len(base) and base[i][0] < e:
            reach, i = max(reach, base[i][2]), i + 1
        if reach <= s:
            out.append((s, k, e))
    return out


def _line(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, max_bits double, clean_text string"


def scan(docs: DataFrame, *, min_bits: float = 40.0, words: Iterable[str] = COMMON, with_text: bool = True) -> DataFrame:
    """A row per row of ``docs``: the columns of ``SCHEMA``; ``clean_text`` only if asked for.

    Needs ``doc_id`` and ``text``; other columns are ignored, whatever their
    names. A null text counts as empty (no spans). Base spans follow the three
    patterns; values in credential contexts that overlap none of them and cost
    ``min_bits`` or more are added as ``guess``; ``words`` are what guessers
    try, the most frequent first. ``clean_text`` has ``[SECRET]`` for each. Repeated rows each give their row; an empty table
    gives an empty result.
    """

    rank = ranks(words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = lru_cache(maxsize=10_000)(lambda value: guess_bits(value, rank))
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                text = text or ""
                base, added, most = find_secrets(text, min_bits, bits)
                line, spans = _line(base), sorted(base + added)
                row = [sum(k == x for _, x, _ in base) for k in range(3)] + [hashlib.sha256(line.encode()).hexdigest(), _line(spans) if added else line, len(added), most]
                if with_text:
                    parts, at = [], 0
                    for s, _, e in spans:
                        if s >= at:
                            parts += [text[at:s], "[SECRET]"]
                        at = max(at, e)
                    row.append("".join(parts) + text[at:])
                rows.append(row)
            out = pd.DataFrame(rows, columns=names[1:])
            out.insert(0, "doc_id", pdf["doc_id"].array)
            yield out

    schema = SCHEMA if with_text else SCHEMA.removesuffix(", clean_text string")
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, schema)
