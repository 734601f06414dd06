"""Product codes against plain Lloyd rounds in Python's integers."""

import hashlib
import math

import numpy as np
import pytest

from sheetlake.llm import vector_codes


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(code, error) for each row of (vec_id, vector), and the hash of the codebooks: every distance computed."""
    kept = [(i, [max(-(2**63), min(2**63 - 1, math.floor(scale * float(x)))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return {}, None
    deep = -(-max(len(v) for _, v in kept) // parts)
    kept = sorted(((i, v + [0] * (deep * parts - len(v))) for i, v in kept), key=lambda r: (r[0] is None, r[0], r[1]))
    cut = [[v[p * deep:(p + 1) * deep] for p in range(parts)] for _, v in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            own = [nearest(c[p], book)[1] for c in cut]
            for j in range(len(book)):
                mine = [c[p] for c, o in zip(cut, own) if o == j]
                if mine:
                    book[j] = [sum(col) // len(mine) for col in zip(*mine)]
    out = []
    for (i, _), c in zip(kept, cut):
        best = [nearest(x, b) for x, b in zip(c, books)]
        out.append((i, "".join(f"{j:02x}" for _, j in best), min(sum(d for d, _ in best), 2**63 - 1)))
    text = ",".join(str(x) for b in books for e in b for x in e)
    return out, hashlib.sha256(text.encode()).hexdigest()


SCHEMA = "vec_id long, embedding array<float>, label int, codebooks_sha256 string"


def check(spark, rows, **how):
    df = spark.createDataFrame([(i, v, lab, "clash") for i, v, lab in rows], SCHEMA)
    got = vector_codes.codes(df, **how).collect()
    want, sha = plain([(i, [float(np.float32(x)) if x is not None else None for x in v] if v is not None else None) for i, v, _ in rows], **{k: v for k, v in how.items() if k != "groups"})
    key = lambda r: (r[0] is None, r)
    assert sorted([(r["vec_id"], r["code"], r["error"]) for r in got], key=lambda r: (r[0] is None, r[0] or 0, r[1:])) == sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))
    assert {r["codebooks_sha256"] for r in got} == ({sha} if want else set())
    return got


def test_random_vectors_as_plain(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 32))
    rows = [(i * 7 % 401, (centres[i % 9] + rng.normal(scale=0.3, size=32)).tolist(), i % 4 if i % 5 else None) for i in range(400)]
    got = check(spark, rows)
    by = {}
    label = {r[0]: r[2] for r in rows}
    for r in got:
        by.setdefault(label[r["vec_id"]], []).append(r)
    for some in by.values():
        assert {r["label_error"] for r in some} == {sum(r["error"] for r in some)}


@pytest.mark.parametrize("groups", [1, 3, 16])
def test_ties_on_a_lattice_as_plain(spark, groups):
    rng = np.random.default_rng(groups)
    rows = [(i, (rng.integers(0, 3, 16) / 4096).tolist(), 1) for i in range(300)]
    check(spark, rows, groups=groups)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, None, 1), (6, [1.0, None], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 2), (3, [], None), (None, [0.5] * 9, None), (1, [1e30] * 9, 1), (2, [-1e30] * 9, 1), (2, [0.25] * 8, 2), (2, [0.25] * 8, 2)]
    got = check(spark, rows)
    assert len(got) == 6
    assert max(r["error"] for r in got) <= 2**63 - 1


def test_fewer_rows_than_entries_and_none(spark):
    check(spark, [(1, [0.1] * 16, 1), (9, [0.3] * 16, 1)])
    assert vector_codes.codes(spark.createDataFrame([], SCHEMA)).collect() == []
    assert vector_codes.codes(spark.createDataFrame([(1, None, 1, "x")], SCHEMA)).collect() == []


def test_many_equal_vectors_are_not_gathered(spark):
    rows = [(i, [0.5] * 16 if i % 3 else [i / 1000] * 16, 0) for i in range(900)]
    check(spark, rows)


def test_bounds_hold_over_many_rounds():
    rng = np.random.default_rng(5)
    for case in range(20):
        x = rng.normal(scale=500, size=(600, 8)).round()
        book = x[:16].copy()
        groups = vector_codes.grouped(book, 4)
        now = vector_codes.Book(book, groups)
        own, upper, lower = np.zeros(600, int), np.full(600, np.float32(3e38)), np.zeros((600, len(groups)), np.float32)
        for _ in range(12):
            now.assign(x, own, upper, lower)
            assert (own == vector_codes.squared(x[:, None], now.entries[None]).argmin(1)).all()
            new = vector_codes.updated(now.entries, vector_codes.sums(x, own, 16).reshape(-1).tolist())
            now = vector_codes.Book(new, groups, now.entries)


def test_bounds_skip_scans():
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (16, 8))
    x = (centres[rng.integers(0, 16, 4000)] + rng.integers(-50, 50, (4000, 8))).astype(np.float64)
    groups = vector_codes.grouped(centres.astype(np.float64), 4)
    own, upper, lower = np.zeros(4000, int), np.full(4000, np.float32(3e38)), np.zeros((4000, len(groups)), np.float32)
    book = vector_codes.Book(centres.astype(np.float64), groups)
    stats = {}
    book.assign(x, own, upper, lower, stats)
    moved = vector_codes.Book((centres + 3).astype(np.float64), groups, book.entries)
    first, stats = dict(stats), {}
    moved.assign(x, own, upper, lower, stats)
    assert stats["scans"] < 0.1 * stats["all"] <= first["all"]
    assert (own == vector_codes.squared(x[:, None], moved.entries[None]).argmin(1)).all()
