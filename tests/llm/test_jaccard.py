"""The join against all pairs, in plain Python."""

import random
import re

import pyarrow as pa
import pytest

from sheetlake.llm import jaccard_join, shingles
from sheetlake.llm.components import components


def words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def shingle_set(t):
    w = words(t)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                comp[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return sorted((rows[i][0], len(sets[i]), min(groups[find(i)])) for i in range(len(rows)))


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeÉé", k=rng.randint(1, 6))) for _ in range(400)]
    passage = rng.choices(vocabulary, k=30)
    rows = []
    for _ in range(60):
        base = rng.choices(vocabulary, k=rng.randint(1, 80))
        if rng.random() < 0.4:
            base += passage
        for _ in range(rng.choice([1, 1, 2, 3, 8])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            sep = rng.choice([" ", "\n", "\t ", "\x0b"])
            rows.append(sep.join(w).upper() if rng.random() < 0.2 else sep.join(w))
    rng.shuffle(rows)
    rows += ["", " \n", None, "one", "one", "ONE", "one two three four", "a b c d e", "A B C D E", "x " * 3000, "x y z w v u"]
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_join_is_complete(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 5, "c") for i, t in rows], "doc_id long, text string, n int, cls string").repartition(3)
    got = jaccard_join.near_duplicates(docs, local_repeats=2 if seed == 1 else 3, few_pairs=100 if seed == 1 else 0, most_frequent=50 if seed == 3 else 1000, most_members=4 if seed == 2 else 1024)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows)


def test_all_ways_agree(spark):
    rows = corpus(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.near_duplicates(docs, most_frequent=0, most_ids=0)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows)


def test_empty_nulls_and_repeats(spark):
    schema = "doc_id long, text string, source string"
    assert jaccard_join.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    docs = spark.createDataFrame([(7, "a b c d e f", "s"), (7, "a b c d e f", "s"), (None, "a b c d e f", "t"), (3, "A b c d e f", None), (9, None, None)], schema)
    got = sorted(map(tuple, jaccard_join.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(7, 2, 3), (7, 2, 3), (None, 2, 3), (3, 2, 3), (9, 0, 9)], key=str)
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 9]


def test_shingle_sets_by_chunks():
    rows = [t for _, t in corpus(5)]
    small = [len(x) for x in shingles.shingle_sets(pa.array(rows), chunk=64)]
    assert small == [len(shingle_set(t)) for t in rows]
    assert [x.tolist() for x in shingles.shingle_sets(pa.array(rows).slice(7), chunk=1 << 20)] == [x.tolist() for x in shingles.shingle_sets(pa.array(rows), chunk=50)][7:]


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(200)] + [(1000 + rng.randrange(300), 1000 + rng.randrange(300)) for _ in range(200)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    comp = {x: x for e in links for x in e}
    for _ in range(400):
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert got == {k: v for k, v in comp.items() if k != v}


def test_bitmaps_never_rule_out_a_link():
    import numpy as np

    rng = np.random.default_rng(1)
    ruled_out = apart = 0
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([rng.permutation(a)[: rng.integers(0, n + 1)], rng.integers(0, 2**63, int(rng.integers(0, n // 2 + 1))).astype(np.uint64)]))
        if not len(b):
            continue
        may = jaccard_join.may_reach(jaccard_join.bitmap(a), jaccard_join.bitmap(b), len(a), len(b), 75)
        assert may or not jaccard_join.similar(a, b, 75)
        share = jaccard_join.may_share(jaccard_join.order_marks(a, 75), jaccard_join.order_marks(b, 75))
        assert share or not jaccard_join.similar(a, b, 75)
        ruled_out += not may
        apart += not share
    assert ruled_out > 100 and apart > 5


def test_hot_buckets_in_parts(spark):
    # near copies of one text by the hundred, and many texts with one passage
    rng = random.Random(7)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(150):
        w = list(base)
        w[rng.randrange(80)] = f"x{i}"
        rows.append(" ".join(w))
    rows += [" ".join(base[:30] + [f"y{i}_{j}" for j in range(60)]) for i in range(60)]
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for turns in (1, 3):
        got = jaccard_join.near_duplicates(docs, most_members=16, turns=turns, few_pairs=0)
        assert sorted(map(tuple, got.collect())) == brute(rows)


def test_groups_over_batches():
    import itertools

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(8)
    for case in range(200):
        keys = np.sort(rng.integers(0, rng.integers(1, 8), rng.integers(0, 40)))
        rows = np.arange(len(keys))
        cuts = np.sort(rng.integers(0, len(keys) + 1, rng.integers(0, 6)))
        batches = [pa.RecordBatch.from_arrays([pa.array(k), pa.array(r)], names=["key", "row"]) for k, r in zip(np.split(keys, cuts), np.split(rows, cuts))]
        got = [(k, v.tolist()) for k, (v,) in jaccard_join._groups(iter(batches), "key", ["row"])]
        want = [(k, [i for _, i in g]) for k, g in itertools.groupby(zip(keys.tolist(), rows.tolist()), key=lambda x: x[0])]
        assert got == [(k, g) for k, g in want if len(g) > 1]
