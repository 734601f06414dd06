"""Spelling variants against all pairs of words in plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from sheetlake.llm import spelling


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:i] + b[i + 1:] for i in range(len(b)))


def plain(docs, least=7, drop=31):
    count = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % drop == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least:
                count[run] += 1
    words = {w: n for w, n in count.items() if n >= 2}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


def check(spark, docs):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, word string, n int")
    got = [tuple(r) for r in spelling.variants(df).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(docs)
    return got


def test_random_words_as_plain(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abéÿÀ") for _ in range(rng.randint(7, 9))) for _ in range(60)]

    def typed(w):
        k = rng.randrange(len(w))
        return rng.choice([w, w, w, w[:k] + w[k + 1:], w[:k] + rng.choice("abé") + w[k:], w[:k] + rng.choice("ab") + w[k + 1:]])

    docs = [(i, " ".join(typed(rng.choice(base[:1 + i % 60])) for _ in range(60))) for i in range(80)]
    got = check(spark, docs)
    assert any(r[1] for r in got)


def test_chains_of_forms_and_ties(spark):
    words = {"aaaaaaab": 1000, "aaaaaabb": 100, "aaaaabbb": 10, "aaaabbbb": 2, "zzzzzzza": 20, "zzzzzzzb": 20, "zzzzzzzc": 2, "zzzzzzz": 2}
    docs = [(None, " ".join([w] * n)) for w, n in words.items()]
    got = {r[0]: r for r in check(spark, docs)}
    if "zzzzzzzc" in got:
        assert got["zzzzzzzc"][1] in (None, "zzzzzzza")


def test_odd_texts(spark):
    long = "ab" * 3000
    docs = [(1, None), (2, ""), (3, "short words only"), (4, "ÀÀÀÀÀÀÀ ÀÀÀÀÀÀÀ àààààà\u00d7 àààààà\u00f7 ABCDEFG abcdefg"), (4, "abcdefg" * 3), (5, f"{long} {long} {long}x {long}x"), (6, "letters1letters2letters_letterś")]
    check(spark, docs)
    check(spark, [(7, "aaaaaaa bbbbbbb")])
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_each_neighbour_comes_once_and_all_come():
    alphabet = "abc"
    hashes = spelling.Hashes(np.array(sorted(map(ord, alphabet)), np.uint32))
    everything = np.full(1 << 12, 255, np.uint8)  # a bitmap that lets all through
    for w in ("a", "ab", "aabbca", "ccccccc"):
        got = [t for _, ts in spelling.neighbours([w], hashes, everything, 15) for t in ts]
        n = len(w)
        want = {w[:i] + w[i + 1:] for i in range(n)} | {w[:i] + c + w[i + 1:] for i in range(n) for c in alphabet} | {w[:i] + c + w[i:] for i in range(n + 1) for c in alphabet}
        want -= {w, ""}
        assert len(got) == len(set(got)) and set(got) == want


def test_hashes_of_neighbours_are_those_of_their_texts():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdef") for _ in range(8)) for _ in range(300)]
    hashes = spelling.Hashes(np.array(sorted(map(ord, "abcdef")), np.uint32))
    bits = 20
    bitmap = np.zeros(1 << (bits - 3), np.uint8)
    for w in words:
        for t in range(spelling.TESTS):
            p = int(spelling.places(hashes.of(spelling.matrix([w], 8)), bits, t)[0])
            bitmap[p >> 3] |= 1 << (p & 7)
    for other in {w[:3] + w[4:] for w in words} | {w[:2] + "a" + w[2:] for w in words} | {w[:5] + "b" + w[6:] for w in words}:
        got = {t for _, ts in spelling.neighbours([other], hashes, bitmap, bits) for t in ts}
        assert {w for w in words if one_edit(w, other)} <= got
