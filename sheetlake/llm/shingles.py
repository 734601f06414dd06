"""Sets of word-shingle hashes, computed over whole Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
_U = np.uint64
_PRIME, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them (the finaliser of splitmix64)."""
    z = x + _U((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


#: A random number for each byte; A-Z have those of a-z.
_BYTES = mix(np.arange(256, dtype=np.uint64), 7)
_BYTES[65:91] = _BYTES[97:123]
#: White space of [\x20\x09-\x0D].
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_PLACES = mix(np.arange(WIDTH, dtype=np.uint64), 11) | _U(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, up to ``n``."""
    if len(_POWERS.get("up", ())) <= n:
        size = max(n + 1, 1 << 19)
        for name, base in (("up", _PRIME), ("down", _INVERSE)):
            steps = np.full(size, _U(base))
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def _word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of the row it stands in) for rows that begin at ``starts`` in ``data``."""
    blank = _BLANK[data]
    first = np.zeros(len(data) + 1, bool)
    first[starts] = True
    word = ~blank
    begins = word.copy()
    begins[1:] &= blank[:-1] | first[1:-1]
    at = np.flatnonzero(begins)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends_here = word.copy()
    ends_here[:-1] &= blank[1:] | first[1:-1]
    to = np.flatnonzero(ends_here) + 1
    up, down = _powers(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTES[data] * up[:len(data)], out=sums[1:])
    h = (sums[to] - sums[at]) * down[at]
    return mix(h + (to - at).astype(np.uint64)), np.searchsorted(starts, at, side="right") - 1


def shingle_sets(texts: pa.Array, chunk: int = 1 << 18) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text; shorter texts have their whole sequence as one.

    Words are runs of other than ``[\\x20\\x09-\\x0D]``, with A-Z in lower
    case. A null text or one without words has none.
    """
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    none = texts.is_null().to_numpy(zero_copy_only=False)
    row = 0
    while row < len(texts):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + chunk, side="right")) - 1)
        to = min(to, len(texts))
        part = data[offsets[row]:offsets[to]]
        # rows without bytes share a start with the next row, so words are counted for rows that have some
        sizes = np.diff(offsets[row:to + 1])
        full = np.flatnonzero(sizes)
        words, owner = _word_hashes(part, (offsets[row:to] - offsets[row])[full])
        counts = np.zeros(to - row, np.int64)
        counts[full] = np.bincount(owner, minlength=len(full)) if len(full) else 0
        ends = np.cumsum(counts)
        if len(words) >= WIDTH:
            n = len(words) - WIDTH + 1
            grams = words[:n] * _PLACES[0]
            for k in range(1, WIDTH):
                grams = grams + words[k:k + n] * _PLACES[k]
            grams = mix(grams, 3)
        for i in range(to - row):
            n, end = int(counts[i]), int(ends[i])
            if none[row + i] or not n:
                yield np.zeros(0, np.uint64)
            elif n < WIDTH:
                yield mix((words[end - n:end] * _PLACES[:n]).sum(dtype=np.uint64, keepdims=True), 20 + n)
            else:
                yield np.unique(grams[end - n:end - WIDTH + 1])
        row = to


def class_id(values: np.ndarray) -> int:
    """A signed 64-bit name of a set of shingles."""
    s = mix(values, 5).sum(dtype=np.uint64, keepdims=True) ^ mix(values, 6).sum(dtype=np.uint64, keepdims=True) * _U(_PRIME)
    return int(mix(s + _U(len(values)), 9).astype(np.int64)[0])
