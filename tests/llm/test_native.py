"""Exact dedup and personal data against plain Python."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sheetlake.llm import exact_dedup, pii

DOCS = "doc_id long, text string, h int, n string"


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


TEXTS = [None, "", "", "Same TEXT", "same text", "SAME text", "É x", "é x", "İstanbul ǅ Ⅷ", "istanbul ǅ ⅷ", "x" * 50000, "X" * 50000, "K", "k", " same text"]


@pytest.mark.parametrize("bits", [64, 2])
def test_exact_dedup(spark, bits):
    rows = [(i, t, i, "z") for i, t in enumerate(TEXTS)] + [(3, "Same TEXT", 0, "z"), (None, "é x", 1, None), (None, "only", 1, None)]
    docs = spark.createDataFrame(rows, DOCS)
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[low(t)].append(i)
    want = []
    for i, t, *_ in rows:
        ids = [x for x in groups[low(t)] if x is not None]
        keep = max(ids) if ids else None
        want.append((i, keep, len(groups[low(t)]), i == keep, hashlib.sha256(low(t).encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup.exact_duplicates(docs, capacity=2, key_bits=bits).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)
    kept = exact_dedup.drop_exact_duplicates(docs, key_bits=bits)
    assert kept.columns == docs.columns
    assert sorted(low(r.text) for r in kept.collect()) == sorted(groups)


def test_exact_dedup_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    assert exact_dedup.exact_duplicates(docs).count() == 0
    assert exact_dedup.drop_exact_duplicates(docs).count() == 0


def in_bucket(h, depth, bucket):
    return (h & (2**64 - 1)) >> (64 - depth) == (bucket & (2**64 - 1)) >> (64 - depth) if depth else bucket == 0


@pytest.mark.parametrize("capacity", [1, 7, 50, 5000])
def test_directory_doubles_until_buckets_fit(spark, capacity):
    # keys that are spread, and some that agree in all but their last bits
    keys = spark.range(1000).select(F.xxhash64("id").alias("h")).unionByName(spark.range(40).select((F.col("id") + (5 << 60)).alias("h"))).distinct()
    every = [k.h for k in keys.collect()]
    rows = exact_dedup.directory(keys, capacity).collect()
    held = [sum(in_bucket(h, r.local_depth, r.bucket) for h in every) for r in rows]
    assert sum(held) == 1040 and 0 < min(held) and max(held) <= capacity
    found = exact_dedup.located(keys, exact_dedup.directory(keys, capacity)).collect()
    assert len(found) == 1040 and all(in_bucket(r.h, r.local_depth, r.bucket) for r in found)
    # no bucket could have done with fewer bits
    for r in rows:
        if r.local_depth:
            assert sum(in_bucket(h, r.local_depth - 1, r.bucket & (-1 << (65 - r.local_depth)) if r.local_depth > 1 else 0) for h in every) > capacity


def test_index_lies_in_its_buckets_and_answers(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("Text "), F.col("id") % 500).alias("text"))
    keys, buckets, index = exact_dedup.build_index(docs, capacity=20)
    rows = index.collect()
    held = defaultdict(int)
    for r in rows:
        assert in_bucket(r.h, r.local_depth, r.bucket)
        held[r.bucket] += 1
    assert len(rows) == 500 and max(held.values()) <= 20 and len(held) == buckets.count() >= 25
    # whole buckets lie in one file each
    assert index.select("bucket", F.input_file_name().alias("f")).distinct().count() == len(held)
    other = spark.createDataFrame([(1, "TEXT 3"), (2, "text 500"), (3, None)], "doc_id long, text string")
    assert [tuple(r)[:2] for r in exact_dedup.seen_before(other, buckets, index).collect()] == [(1, 503)]
    # rows are found through their own bucket only
    wrong = buckets.limit(buckets.count() - 1)
    assert 0 < 600 - exact_dedup.lookup(keys, wrong, index).count() <= 60


def brute_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_patterns(spark):
    texts = [
        None, "", "a@b.c_d@e.f g@h", "x@y.z.@q.r a.b@c-d.e-f.g.", "1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.255 1.2.3.99999999999999999999",
        "4111 1111 1111 1111, 4111-1111-1111-1112 4111  1111 1111 1111 378282246310005 12345678901234567890",
        "+1 (415) 555-0100. +44 20 7946 0958- +1 2 3 +123456789012345678 +4 930 12345678", "é😀 a@b.co 😀😀 10.0.0.1",
        "@" * 2000 + "a" * 100000 + "@b.c", "1" * 60000 + ".1.1.1", "a.a" * 30000, "1 " * 30000, "+" * 3000 + "1" * 12,
        "a@b.c " * 500, "7" * 40 + "@" + "7.7.7.7",
    ]
    docs = spark.createDataFrame([(i, t, 0, "q") for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r for r in pii.sanitise(docs, with_text=False).collect()}
    for i, t in enumerate(texts):
        want = brute_spans(t or "")
        line = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert got[i].spans == line, (i, got[i].spans[:200], line[:200])
        assert [got[i][f"n_{k}"] for k in pii.KINDS[:4]] == [sum(x[1] == k for x in want) for k in range(4)]
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest()


def test_revealing_terms(spark):
    rows = [(i, f"Meet Zorblax at q{i} about the plan mail boss@corp.example now", 0, "") for i in range(4)]
    rows += [(10 + i, f"the plan is at home about w{i} now meet mail", 0, "") for i in range(40)]
    rows += [(100 + i, "copied Quux 10.1.1.1", 0, "") for i in range(9)]
    got = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[0].n_term == 1 and "term:5:12" in got[0].spans
    assert got[0].clean_text == "Meet  at q0 about the plan mail [EMAIL] now"
    assert all(got[i].n_term == 0 for i in got if i >= 10)  # clean documents, and copies of one text
    assert got[10].clean_text == rows[4][1] and got[100].clean_text == "copied Quux [IP]"
    assert pii.sanitise(spark.createDataFrame([], DOCS)).count() == 0


def test_terms_of_entity_classes(spark):
    # no address occurs twice; the domain does, and two texts with one address are tested too
    rows = [(i, f"Vexil wrote from home w{i} u{i}@corp.example to us", 0, "") for i in range(6)]
    rows += [(100 + i, f"nothing to us from home or elsewhere v{i}", 0, "") for i in range(3000)]
    rows += [(9000 + i, f"from Quillon +1 415 555 0100 {'at home' * i}", 0, "") for i in range(2)]
    rows += [(9100, "lonely Umbrix 10.1.1.1", 0, ""), (9200, "dial 555 0100 now", 0, "")]
    got = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i].clean_text == f"  from home w{i} [EMAIL] to us" for i in range(6))
    assert got[9000].clean_text == "from  [PHONE] " and got[9001].clean_text == "from  [PHONE] at home"
    # one text is no evidence, nor are an identifier's own digits
    assert got[9100].n_term == 0 and got[9200].n_term == 0 and got[100].n_term == 0


@pytest.mark.parametrize("bound,size", [(1_000_000, 64 << 20), (0, 64 << 20), (1_000_000, 0)])
def test_revealing_terms_without_the_entity(spark, bound, size):
    rows = [(i, f"Zorblax w{i} mail boss@corp.example now", 0, "") for i in range(20)]
    rows += [(50, "now ask zorblax, then Zorblax", 0, ""), (51, "now ask a@b.zorblax.c", 0, ""), (52, None, 0, "")]
    rows += [(100 + i, f"mail at home now v{i}", 0, "") for i in range(2000)]
    got = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, DOCS), broadcast_rows=bound, broadcast_bytes=size).collect()}
    assert len(got) == len(rows) and got[0].n_term == 1 and got[100].n_term == 0
    assert got[50].n_term == 2 and got[50].spans == "term:8:15,term:22:29" and got[50].clean_text == "now ask , then "
    assert got[51].n_term == 0 and got[51].clean_text == "now ask [EMAIL]"


def test_generalised_terms(spark):
    # with the entity in 20 texts and elsewhere in one or two more: over 0.85 of its information, below 0.95
    rows = [(i, f"Zorblax 77quux vexil and w{i} mail boss@corp.example now", 0, "") for i in range(20)]
    rows += [(50 + i, f"ask Zorblax then 77QUUX, vexil; x{i}", 0, "") for i in range(8)] + [(70, "Vexil " * 400 + "a@b.co " * 300, 0, "")]
    rows += [(100 + i, f"mail at home and now v{i}", 0, "") for i in range(2000)]
    got = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[0].clean_text == "[NAME] [NUMBER] [WORD] and w0 mail [EMAIL] now" and got[0].n_term == 3 and got[0].n_removed == 0
    assert got[51].clean_text == "ask [NAME] then [NUMBER], [WORD]; x1" and got[100].clean_text == rows[29][1]
    assert got[70].clean_text == "[NAME] " * 400 + "[EMAIL] " * 300 and got[70].n_term == 400


def test_cleaned_text_with_many_and_overlapping_marks(spark):
    import random

    rng = random.Random(3)
    rows = []
    for i in range(30):
        text = "".join(rng.choices("abé😀 ", k=rng.randint(0, 900)))
        marks = sorted((a, min(len(text), a + rng.randint(0, 6)), rng.choice(["", "[X]"])) for a in (rng.randint(0, len(text)) for _ in range(rng.choice([0, 1, 5, 127, 128, 129, 400]))))
        rows.append((i, text, marks))
    df = spark.createDataFrame(rows, "i int, text string, marks array<struct<start:int,end:int,label:string>>")
    got = {r.i: r.c for r in df.select("i", pii._cleaned(F.col("text"), F.col("marks")).alias("c")).collect()}
    for i, text, marks in rows:
        out, at = [], 0
        for s, e, label in marks:
            if s >= at:
                out += [text[at:s], label]
            at = max(at, e)
        assert got[i] == "".join(out) + text[at:], i


def test_small_sides_are_small_in_rows_and_bytes(spark):
    from sheetlake.llm.staging import ROW_BYTES, small_side

    df = spark.range(10).select("id", F.repeat(F.lit("x"), 100).alias("s"))
    json_bytes = len('{"id":0,"s":""}') + 100
    sent = lambda *bounds: "ResolvedHint" in small_side(df, *bounds)._jdf.queryExecution().analyzed().toString()
    whole = 10 * (json_bytes + ROW_BYTES)
    assert sent(10) and not sent(9) and sent(10, whole) and not sent(10, whole - 1) and not sent(9, whole)
    assert small_side(df.limit(0), 0, 0).count() == 0
