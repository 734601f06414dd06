"""Tokenizer, chat pairs, web pages, mixing and quality against plain forms of the same."""

import itertools
import random
from array import array

import pytest
from pyspark.sql import functions as F

from sheetlake.llm import chat, html_text, mixing, quality_lm, unigram

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def brute_best(pieces, text, low):
    table = {p: s for p, s, k in pieces if k == "piece"}
    best = float("-inf")
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(text)]
        total = 0.0
        for a, b in zip(at, at[1:]):
            part = text[a:b]
            total += table[part] if part in table else low if b - a == 1 else float("-inf")
        best = max(best, total)
    return best


def test_viterbi_is_best():
    rng = random.Random(2)
    for _ in range(60):
        words = {"".join(rng.choices("ab▁c", k=rng.randint(1, 4))) for _ in range(8)}
        pieces = [("<unk>", 0.0, "other")] + [(f"<0x{i:02X}>", 0.0, "byte") for i in range(256)] + [(w, -rng.randint(1, 9) * 1.0, "piece") for w in sorted(words)]
        codec = unigram.Codec(pieces)
        text = "".join(rng.choices("ab▁cd", k=9))
        ids = codec.viterbi(text)
        score, at = 0.0, 0
        raw = b""
        for i in ids:
            raw += codec.raw[i] if pieces[i][2] == "byte" else pieces[i][0].encode()
            score += pieces[i][1]
        plain = [i for i in ids if pieces[i][2] == "byte"]
        # bytes of characters outside the vocabulary: one price a character
        n_unknown = sum(1 for c in _unknown(codec, text))
        assert score + n_unknown * codec.low == pytest.approx(brute_best(pieces, text, codec.low)) and bool(plain) == bool(n_unknown)


def _unknown(codec, text):
    ids = codec.viterbi(text)
    out = []
    data = bytearray()
    for i in ids:
        if codec.pieces[i][2] == "byte":
            data += codec.raw[i]
    out = bytes(data).decode()
    return out


def test_round_trip_and_words(spark):
    texts = [None, "", " ", "Hello  world\n\n x", "▁", "a▁ b▁▁", "😀 é ﷽ \x00", "mañana schön où", "x" * 3000, " lead", "trail ", "<s> </s> <0x41> <unk>", "the " * 20000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = unigram.encode(docs, MODEL).cache()
    assert all(r.round_trip for r in got.collect()) and got.count() == len(texts)
    back = {r.doc_id: r.text for r in unigram.decode(got, MODEL).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert unigram.encode(docs.limit(0), MODEL).count() == 0
    codec = unigram.Codec(unigram.read_model(MODEL))
    for t in ["Hello  world, it's 2024!\nNew\tline", "a  b   c", "été où là"]:
        whole = array("i", codec.viterbi("▁" + t.replace(" ", "▁"))).tobytes()
        assert codec.encode(t) == whole  # words apart give the same as the whole


def test_chat(spark):
    def turns(pair, *texts, start="user"):
        roles = ["user", "assistant"] if start == "user" else ["assistant", "user"]
        return [(pair, i, roles[i % 2], t, "x") for i, t in enumerate(texts)]

    schema = "pair_id long, turn long, role string, text string, prompt string"
    c = turns(1, "q", "a", "q2", "good") + turns(2, "same", "same") + turns(3, "only") + turns(5, None, "x<|im_end|>y")
    r = turns(1, "q", "a", "q2", "bad!", "more") + turns(2, "same", "same") + turns(4, "other", "z") + turns(5, None, "é")
    got = {x.pair_id: x for x in chat.preference_pairs(spark.createDataFrame(c, schema), spark.createDataFrame(r, schema)).collect()}
    assert [got[i].n_prefix for i in (1, 2, 3, 4, 5)] == [3, 2, 0, 0, 1]
    one = got[1]
    assert one.prompt == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n<|im_start|>user\nq2<|im_end|>\n"
    s, e = map(int, one.chosen_mask.split(":"))
    assert one.chosen[s:e] == "good<|im_end|>" and one.chosen == "<|im_start|>assistant\ngood<|im_end|>\n"
    s, e = map(int, one.rejected_mask.split(":"))
    assert one.rejected[s:e] == "bad!<|im_end|>" and one.usable and not got[2].usable and got[2].chosen == ""
    assert "x< |im_end|>y<|im_end|>" in got[5].chosen and got[3].rejected == "" and got[3].chosen_mask == ""
    none = spark.createDataFrame([], schema)
    assert chat.preference_pairs(none, none).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T & t</title><style>p{}</style><script>var x="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>gone</p> -->
<div class="cookie-notice"><p>We use cookies</p></div><div class='ad'>Buy <div>now</div> please</div>
<article><h1>Title &amp; more</h1><p><b>First   para&nbsp;graph<br>here.<p>Second &lt;one&gt; 1 < 2</p><aside>Related</aside>
<p>See <a href="x">this link</a>, of course.</p><form><input><button>Go</button></form><div id="comments"><p>Great post!</p></div></article>
<footer>&copy; me</footer></body></html>"""


def test_html(spark):
    want = "Title & more\nFirst para graph here.\nSecond <one> 1 < 2\nSee this link, of course."
    assert html_text.main_text(PAGE) == want
    bare = "<body><div><a href=1>Home</a> <a href=2>News</a> <a href=3>About us here</a></div><div>" + "The cat is on the mat and it was not a dog for that. " * 6 + "</div><div>Short end.</div><div>Copyright notice: rights reserved worldwide, 2024 Example Incorporated Ltd.</div></body>"
    assert html_text.main_text(bare).split("\n") == [("The cat is on the mat and it was not a dog for that. " * 6).strip(), "Short end."]
    odd = ["", "<", "<p", "plain", "<p>a<b", "</p></article>", "<article><p>x</p>", "<script>", "<article><p>&#x41;&bogus;&amp</p></article>", "<p class=\"x>y</p>" * 50, "<" * 5000]
    rows = [(i, None, p, 3) for i, p in enumerate([None, PAGE, *odd])]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()}
    assert got[0].text == "" and got[0].n_chars == 0 and got[1].text == want and got[1].n_chars == len(want)
    assert got[8].text == "x" and got[10].text == "A&bogus;&"
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def brute_quota(sizes, weights):
    targets, open_, total = {}, set(sizes), sum(sizes.values())
    while True:
        room = total - sum(targets.values())
        share = {s: room * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return targets | share
        for s in over:
            targets[s] = 3 * sizes[s]
            open_.discard(s)


def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "b", "b", "b", "b", "Z", None]), 9) for i in range(3000)]
    rows += [(5000 + i, "x\x0by", "tiny", 1) for i in range(3)] + [(6000, None, "a", 1), (6001, "\n", "empty", 1), (7000, "q " * 4000, "b", 0)] + [(1, "dup words", "a", 0)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(docs, slice_docs=50).collect()
    assert sorted((r.doc_id, r.size) for r in got) == sorted((i, len((t or "").replace("\x0b", " ").split())) for i, t, *_ in rows)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").replace("\x0b", " ").split())
    weights = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    want, taken = brute_quota(sizes, weights), {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 3 for s in sizes), (taken, want)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7), slice_docs=50).collect()), key=str)
    assert mixing.mix(docs.limit(0)).count() == 0
    again = mixing.mixed_documents(docs, slice_docs=50)
    assert again.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in again.collect()) == sum(taken.values())


def cheapest(supply, quota, costs=(0, 1, 3)):
    """Minimum-cost flow by Bellman-Ford paths, unit by unit of cost: (tokens routed, cost)."""
    edges, nodes = [], {"S": 0, "T": 1}

    def add(a, b, room, price):
        a, b = nodes.setdefault(a, len(nodes)), nodes.setdefault(b, len(nodes))
        edges.extend([[a, b, room, price], [b, a, 0, -price]])

    for p, n in supply.items():
        for c in costs:
            add("S", ("p", p), n, c)
        for s in p:
            add(("p", p), ("s", s), 10**9, 0)
    for s, n in quota.items():
        add(("s", s), "T", n, 0)
    routed = spent = 0
    while True:
        far, came = {0: 0}, {}
        for _ in nodes:
            for i, (a, b, room, price) in enumerate(edges):
                if room and a in far and far[a] + price < far.get(b, 10**9):
                    far[b], came[b] = far[a] + price, i
        if 1 not in far:
            return routed, spent
        path, at = [], 1
        while at:
            path.append(came[at])
            at = edges[came[at]][0]
        push = min(edges[i][2] for i in path)
        for i in path:
            edges[i][2] -= push
            edges[i ^ 1][2] += push
        routed, spent = routed + push, spent + push * far[1]


def test_flow_is_cheapest():
    rng = random.Random(9)
    for _ in range(150):
        names = "abcdef"[: rng.randint(1, 6)]
        supply = {tuple(sorted(rng.sample(names, rng.randint(1, len(names))))): rng.randint(0, 30) for _ in range(rng.randint(1, 8))}
        quota = {s: rng.randint(0, 40) for s in names}
        flow = mixing.min_cost_flow(supply, quota)
        cost = sum(max(0, min(flow[p], 2 * n) - n) + 3 * max(0, flow[p] - 2 * n) for p, n in supply.items())
        assert (sum(flow.values()), cost) == cheapest(supply, quota) and all(f <= 3 * supply[p] for p, f in flow.items())
    import time

    began = time.time()
    many = {tuple(sorted({f"s{rng.randrange(3000)}" for _ in range(3)})): rng.randint(1, 1000) for _ in range(30_000)}
    flow = mixing.min_cost_flow(many, {f"s{i}": rng.randint(1, 9000) for i in range(3000)})
    assert time.time() - began < 60 and sum(flow.values()) > 0


def test_flow_over_overlapping_sources(spark):
    flow = mixing.min_cost_flow({("a",): 10, ("a", "b"): 10, ("b",): 0}, {"a": 15, "b": 15})
    assert flow == {("a",): 10, ("a", "b"): 20, ("b",): 0}
    rows = [(i, "w " * 10, ["a"] if i % 3 == 0 else ["b", "a", "a"] if i % 3 == 1 else []) for i in range(90)]
    rows += [(100 + i, "w " * 10, [None, "null", "\x1f"][: 1 + i % 3]) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    got = mixing.mix(docs).collect()
    assert len(got) == 120 and abs(sum(r.taken for r in got) - 1200) <= 40
    again = mixing.mixed_documents(docs)
    assert again.columns == docs.columns and again.count() * 10 == sum(r.taken for r in got)


def test_mix_of_odd_and_many_sources(spark):
    odd = [(1, "a b", "\x00"), (2, "a b", None), (3, "a b c", "null"), (4, "x", ""), (4, "x", "")]
    docs = spark.createDataFrame(odd, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3, 4, 4] and {(r.doc_id, r.source_size) for r in got} == {(1, 2), (2, 2), (3, 3), (4, 2)}
    many = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("w w w").alias("text"), F.concat(F.lit("host"), "id").alias("source"))
    assert mixing.mix(many).agg(F.count("*"), F.sum("target"), F.max(F.abs(F.col("taken") - F.col("target")))).first()[:] == (60_000, 180_000.0, 1.5)
    # the same row many times over, and a large source cut in several rounds
    rows = [(7, "w w w", "big")] * 3000 + [(i, "w " * (i % 7), "big") for i in range(5000)] + [(9000, "w " * 2500, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, slice_docs=3).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.count("*").alias("n")).collect()
    assert {r.source: r.n for r in got} == {"big": 8000, "other": 1} and all(abs(r.taken - r.target) <= 3 for r in got if r.source == "big")
    assert mixing.mixed_documents(docs, slice_docs=3).filter("source = 'big'").select(F.sum(mixing.word_count(F.col("text")))).first()[0] == next(r.taken for r in got if r.source == "big")


def brute_lm(trusted, texts):
    """Interpolated modified Kneser-Ney over characters, by its definition."""
    import math
    from collections import Counter, defaultdict

    def grams(t, n):
        t = " ".join(t.split())
        u = "\x01" * 3 + t
        return [u[i - n + 1:i + 1] for i in range(3, len(u))] if t else []

    counts = {4: Counter(g for t in trusted for g in grams(t, 4))}
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    d = {}
    for n in counts:
        c = Counter(counts[n].values())
        n1, n2, n3, n4 = (c[i] for i in (1, 2, 3, 4))
        if not n1 or not n2:
            d[n] = (0.5, 0.75, 0.9)
        else:
            y = n1 / (n1 + 2 * n2)
            x = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0)
            d[n] = tuple(min(max(v, 0.01), i + 0.99) for i, v in enumerate(x))
    total, lost = defaultdict(float), defaultdict(float)
    for n in counts:
        for g, c in counts[n].items():
            total[n, g[:-1]] += c
            lost[n, g[:-1]] += d[n][min(c, 3) - 1]
    size = len(counts[1]) + 1

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / size
        if (n, g[:-1]) not in total:
            return p(g[1:])
        c = counts[n].get(g, 0)
        own = (c - d[n][min(c, 3) - 1]) / total[n, g[:-1]] if c else 0
        return own + lost[n, g[:-1]] / total[n, g[:-1]] * p(g[1:])

    return [math.exp(-sum(math.log(p(g)) for g in grams(t, 4)) / len(grams(t, 4))) if grams(t, 4) else None for t in texts]


def test_language_model(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["the", "cat", "Sat", "on", "mats", "été"], k=12)), "en" if i % 2 else None, "p") for i in range(80)]
    rows += [(200, None, "en", ""), (201, "  ", "en", ""), (202, "### $$$ QQQ!!", "en", ""), (203, "zz 😀", "xx", ""), (3, rows[3][1], "en", "")]
    labels = [(i, 1, 0) for i in range(40)] + [(202, 0, 0), (5, 0, 1), (6, None, None), (None, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, perplexity string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    good = spark.createDataFrame([(i,) for i in range(40) if i != 5], "i long").filter("pmod(xxhash64(i), 5) <> 0").collect()
    trusted = [t for i, t, *_ in rows if i in {r.i for r in good}]
    want = brute_lm(trusted, [t or "" for _, t, *_ in rows])
    got = sorted(map(tuple, quality_lm.judge(docs, marks, least=5).select("doc_id", "perplexity", "keep").collect()))
    for (i, p, keep), (j, q) in zip(got, sorted((r[0], q) for r, q in zip(rows, want))):
        assert i == j and (p is None and q is None or p == pytest.approx(q, rel=1e-4)), (i, p, q)
        assert keep or i >= 200 or i not in {r.i for r in good}
        assert not keep or i < 200
    joined = sorted(map(tuple, quality_lm.judge(docs, marks, least=5, max_broadcast=0).select("doc_id", "perplexity", "keep").collect()))
    assert [x[::2] for x in joined] == [x[::2] for x in got] and all(a[1] == pytest.approx(b[1], rel=1e-4) for a, b in zip(joined, got) if a[1])
    kept = quality_lm.keep_good(docs, marks, least=5)
    assert kept.columns == docs.columns and kept.count() == sum(k for *_, k in got)
    assert quality_lm.judge(docs.limit(0), marks).count() == 0
    assert quality_lm.judge(docs, marks.limit(0)).filter("keep").count() == 83


def test_held_out_quality(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    train = labels.filter(F.col("doc_id") % 2 == 0)
    held = quality_lm.judge(docs, train).join(labels.filter(F.col("doc_id") % 2 == 1), "doc_id")
    right = held.filter("toxic = 0").agg(F.avg((F.col("keep") == (F.col("quality") == 1)).cast("int"))).first()[0]
    clean = held.filter("toxic = 0 AND quality = 1").agg(F.avg(F.col("keep").cast("int"))).first()[0]
    assert right > 0.95 and clean > 0.95


def test_html_without_or_beside_articles():
    body = "The cat is on the mat and it was not a dog for that. " * 6
    card = "<article><h3>Next one</h3><p>Read how the dog is at home and what it does there in the evening.</p><a href=x>More</a></article>"
    page = f"<body><div>{body}</div><div>{body}</div>{card * 3}</body>"
    assert html_text.main_text(page) == f"{body.strip()}\n{body.strip()}"
    # a list of cards alone is what the page has; text beside a longer article is judged by its own words
    assert "evening" in html_text.main_text(f"<body>{card * 3}</body>")
    both = html_text.main_text(f"<body><div>{body}</div><article><h1>Title</h1><p>{body * 2}</p></article><div>All rights reserved worldwide, Example Incorporated Limited, Delaware USA</div></body>")
    assert both == f"{body.strip()}\nTitle\n{(body * 2).strip()}"
    # inside an article a list of links, and a short block beside it, are no text
    links = "<ul><li><a href=1>One long link to another page</a></li><li>or</li><li><a href=2>Two long link to another page</a></li></ul>"
    assert html_text.main_text(f"<article><p>{body}</p>{links}</article>") == body.strip()
    for text in ("Кошка сидит на ковре, и собака смотрит на неё. " * 6, "猫がマットの上に座っている。犬はそれを見ている。" * 8, "Kissa istuu matolla ja koira katsoo sitä. " * 6, "القطة على السجادة والكلب ينظر إليها. " * 6):
        page = f"<body><div><a href=1>Home</a> <a href=2>News of the day</a></div><div>{text}</div><div>{text}</div></body>"
        assert html_text.main_text(page) == f"{text.strip()}\n{text.strip()}"
        assert html_text.main_text(f"<body><article><p>{text}</p></article></body>") == text.strip()
