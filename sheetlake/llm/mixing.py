"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by the set of sources that they belong to. Each
pattern offers its tokens once at no cost, a second time at a price and a
third at a higher one (convex in the number of repetitions); token capacity
flows from patterns to the quotas of their sources at least cost. Sources that
share no pattern, directly or through others, are separate problems. Within a
pattern, every document is taken as often as the flow covers whole passes, and
the rest of the flow picks documents in a seeded order.

Everything that grows with sources or patterns stays in tables; the driver
sees sums only.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .staging import small_side, stage

BLANK = r"[\x20\x09-\x0D]"


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; 0 for null."""
    n = F.size(F.split(text, BLANK + "+", -1)) - text.rlike("^" + BLANK).cast("int") - text.rlike(BLANK + r"\z").cast("int")
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).when(~text.rlike(r"[^\x20\x09-\x0D]"), 0).otherwise(n).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``place``, from 0, in the order of the code points of ``s``, null last."""
    dealt = stage(sources.repartitionByRange(F.asc_nulls_last("s")).withColumn("part", F.spark_partition_id()), "mix-sources")
    before, offsets = 0, []
    for part, n in sorted(map(tuple, dealt.groupBy("part").agg(F.count("*")).collect())):  # a number for each partition
        offsets.append((part, before))
        before += n
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("s"))) - 1
    starts = sources.sparkSession.createDataFrame(offsets, "part int, start long")
    return dealt.withColumn("own", own).join(F.broadcast(starts), "part").withColumn("place", F.col("own") + F.col("start")).drop("own", "start", "part")


def targets(sources: DataFrame, total: int, weights: tuple[int, ...], limit: int) -> DataFrame:
    """(s, source_size, target): shares of ``total`` by weight, none above ``limit`` times its source's size.

    The excess of sources at their limit is shared anew until no other is
    above its own; each round is one sum over the sources.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    held = stage(ranked(sources).select("s", "source_size", weight.alias("w"), (limit * F.col("source_size")).alias("most")), "mix-weights")
    left, share = total, held.agg(F.sum("w")).first()[0]
    capped = 0
    while share:
        over = F.lit(float(left)) * F.col("w") / F.lit(share) > F.col("most")
        n, filled, rest = held.agg(F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, F.col("most"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0))).first()
        if n == capped:
            break
        capped, left, share = n, total - filled, rest
    even = F.lit(float(left)) * F.col("w") / F.lit(share or 1)
    most = F.col("most").cast("double")
    return held.select("s", "source_size", (F.least(even, most) if share else most).alias("target"))


def min_cost_flow(supply: dict, quota: dict, passes: int = 3) -> dict:
    """Tokens taken of each pattern (a tuple of sources) so that the quotas are filled as far as can be, at least cost.

    A pattern's first pass is free and each further one dearer, whatever the
    pattern, and the amounts that can be routed together are independent sets
    of a polymatroid. So it is cheapest to route as much as can be of all
    first passes, then of the second ones, and so on: augmenting never takes
    back what a pattern gives. Each level is a maximum flow by layers.
    """
    patterns = sorted(supply, key=repr)
    names = {s: len(patterns) + 2 + i for i, s in enumerate(sorted(quota, key=repr))}
    start, end = len(patterns), len(patterns) + 1
    graph: list[list[int]] = [[] for _ in range(len(patterns) + 2 + len(names))]
    to: list[int] = []
    room: list[int] = []

    def edge(a: int, b: int, capacity: int) -> int:
        for x, y, c in ((a, b, capacity), (b, a, 0)):
            graph[x].append(len(to))
            to.append(y)
            room.append(c)
        return len(to) - 2

    entries = [edge(start, i, 0) for i in range(len(patterns))]
    for i, p in enumerate(patterns):
        for s in p:
            edge(i, names[s], supply[p] * passes)
    for s, node in names.items():
        edge(node, end, quota[s])
    for _ in range(passes):
        for e, p in zip(entries, patterns):
            room[e] += supply[p]
        _augment(graph, to, room, start, end)
    return {p: room[e ^ 1] for e, p in zip(entries, patterns)}


def _augment(graph: list[list[int]], to: list[int], room: list[int], start: int, end: int) -> None:
    """A maximum flow from what there is: blocking flows over layers of shortest paths."""
    while True:
        layer = [-1] * len(graph)
        layer[start] = 0
        queue = deque([start])
        while queue and layer[end] < 0:
            a = queue.popleft()
            for e in graph[a]:
                if room[e] and layer[to[e]] < 0:
                    layer[to[e]] = layer[a] + 1
                    queue.append(to[e])
        if layer[end] < 0:
            return
        at = [0] * len(graph)
        path: list[int] = []
        node = start
        while True:
            if node == end:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                first = next(i for i, e in enumerate(path) if not room[e])
                node = to[path[first] ^ 1]
                del path[first:]
                continue
            while at[node] < len(graph[node]):
                e = graph[node][at[node]]
                if room[e] and layer[to[e]] == layer[node] + 1:
                    path.append(e)
                    node = to[e]
                    break
                at[node] += 1
            else:
                if node == start:
                    break
                node = to[path.pop() ^ 1]
                at[node] += 1


def flows(patterns: DataFrame, sources: DataFrame, passes: int) -> DataFrame:
    """``patterns`` (key, pattern, size, n) with source_size and target (sums over the sources) and flow.

    A pattern alone with its source needs no search. The others are grouped by
    what links their sources, and each group, a row for each pattern, is one
    flow problem of one task.
    """
    member = patterns.select("key", "size", "n", F.explode("pattern").alias("s"))
    held = member.join(sources, F.expr("s <=> _s")).groupBy("key", "size", "n").agg(
        F.sum("source_size").alias("source_size"), F.sum("target").alias("target"),
        F.collect_list(F.struct(F.col("s"), F.round("target").cast("long").alias("quota"))).alias("wants"),
    )
    held = stage(held, "mix-patterns")
    most = F.least(F.get("wants", F.lit(0))["quota"], F.col("size") * passes)
    if held.filter(F.size("wants") > 1).isEmpty():
        return held.withColumn("flow", most)
    # patterns and sources are nodes; the smallest one reached names the group
    node = F.xxhash64(F.lit("source"), F.col("w.s").isNull(), "w.s")
    links = held.select(F.xxhash64(F.lit("pattern"), "key").alias("u"), F.explode("wants").alias("w")).select("u", node.alias("v"))
    roots = components(links).select(F.col("node").alias("u"), "root")
    grouped = held.withColumn("u", F.xxhash64(F.lit("pattern"), "key")).join(roots, "u", "left").withColumn("root", F.coalesce("root", "u"))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        quota = {w["s"]: int(w["quota"]) for wants in rows["wants"] for w in wants}
        names = [tuple(w["s"] for w in wants) for wants in rows["wants"]]
        taken = min_cost_flow(dict(zip(names, map(int, rows["size"]))), quota, passes)
        return pd.DataFrame({"key": rows["key"], "flow": [taken[x] for x in names]})

    found = grouped.select("root", "key", "size", "wants").groupBy("root").applyInPandas(solve, "key string, flow long")
    return held.join(stage(found, "mix-flow"), "key")


def _fill(sizes: list[int], copies: list[int], left: int) -> list[int]:
    """Documents of one slice in seeded order, as many copies of each as still fit; then the one more that comes nearest."""
    picked = [0] * len(sizes)
    for i, size in enumerate(sizes):
        if size > 0:
            picked[i] = min(copies[i], left // size)
            left -= picked[i] * size
    near = min(((abs(size - left), i) for i, size in enumerate(sizes) if picked[i] < copies[i] and size > 0), default=(left, -1))
    if near[0] < left:
        picked[near[1]] += 1
    return picked


def _fill_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``picked`` for rows that come sorted by key and seeded order; a slice is held at a time."""
    rest = None
    for pdf in chain(batches, [None]):
        rows = rest if pdf is None else pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if rows is None or not len(rows):
            continue
        keys = rows["key"].to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(rows)]
        if pdf is not None:  # the last slice may go on
            rest = rows.iloc[cuts[-2]:].reset_index(drop=True)
            cuts.pop()
        sizes, copies, left = (rows[c].tolist() for c in ("size", "copies", "left"))
        done = rows.iloc[:cuts[-1]].drop(columns="left")
        yield done.assign(picked=[x for a, b in zip(cuts, cuts[1:]) for x in _fill(sizes[a:b], copies[a:b], int(left[a]))])


def edges(sized: DataFrame, plan: DataFrame, slice_docs: int, fan: int = 1024) -> DataFrame:
    """``plan`` with the range [low, high) of the seeded order in which the rest of each pattern runs out, and what is left there.

    The range is narrowed by a factor of up to ``fan`` in each round, by sums
    over parts of it, until it holds about ``slice_docs`` documents.
    """
    state = plan.select("key", "rest", F.lit(0.0).alias("low"), F.lit(1.0).alias("high"), F.lit(0).cast("long").alias("before"), "n")
    for turn in range(12):
        state = stage(state, f"mix-edge-{turn}")
        wide = state.filter((F.col("rest") > 0) & (F.col("n") > slice_docs))
        if wide.isEmpty():
            break
        parts = F.least(F.lit(fan), F.ceil(F.col("n") / slice_docs))
        inside = sized.join(small_side(wide.withColumn("parts", parts), 100_000), "key").filter((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))
        part = F.least(F.floor((F.col("u") - F.col("low")) / (F.col("high") - F.col("low")) * F.col("parts")), F.col("parts") - 1)
        held = inside.groupBy("key", "rest", "low", "high", "before", "parts", part.alias("part")).agg(F.sum(F.col("size") * F.col("copies")).alias("held"), F.count("*").alias("n"))
        up_to = F.col("before") + F.sum("held").over(Window.partitionBy("key").orderBy("part"))
        step = (F.col("high") - F.col("low")) / F.col("parts")
        held = held.withColumn("after", up_to).withColumn("first", F.col("low") + step * F.col("part")).withColumn("to", F.when(F.col("part") + 1 < F.col("parts"), F.col("low") + step * (F.col("part") + 1)).otherwise(F.col("high")))
        cut = held.filter(F.col("after") > F.col("rest")).groupBy("key", "rest").agg(F.min_by(F.struct("first", "to", (F.col("after") - F.col("held")).alias("before"), "n"), "part").alias("x"))
        cut = cut.select("key", "rest", F.col("x.first").alias("low"), F.col("x.to").alias("high"), "x.before", "x.n")
        done = state.join(cut.select("key"), "key", "left_anti")
        # a pattern all of whose documents fit has no edge
        whole = F.when((F.col("rest") > 0) & (F.col("n") > slice_docs), F.lit(2.0)).otherwise(F.col("low"))
        state = done.withColumn("low", whole).withColumn("high", F.greatest("high", "low")).withColumn("n", F.when(F.col("low") > 1, 0).otherwise(F.col("n"))).unionByName(cut)
    return plan.drop("n", "rest").join(state.select("key", "rest", "low", "high", (F.col("rest") - F.col("before")).alias("left")), "key")


def decide(docs: DataFrame, *, source: str = "source", weights: tuple[int, ...] = (1, 2, 3), limit: int = 3, seed: int = 17, slice_docs: int = 2000) -> DataFrame:
    """A row for each different (doc_id, key, size): copies, passes, picked, source_size, target, source.

    ``key`` is the membership pattern as JSON; every one of the ``copies`` is
    taken ``passes`` times, and ``picked`` of them once more.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _pattern(docs, source).alias("pattern"), word_count(F.col("text").cast("string")).alias("size"))
    rows = read.groupBy("doc_id", "pattern", "size").agg(F.count("*").alias("copies")).withColumn("key", F.to_json("pattern"))
    # the place in the seeded order, evenly over [0, 1)
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "key", "size"), 11) / F.lit(float(2**53))
    sized = stage(rows.withColumn("u", u), "mix-sizes")
    patterns = stage(sized.groupBy("key").agg(F.first("pattern").alias("pattern"), F.sum(F.col("size") * F.col("copies")).alias("size"), F.count("*").alias("n")), "mix-totals")
    sources = patterns.select(F.explode("pattern").alias("s"), "size").groupBy("s").agg(F.sum("size").alias("source_size"))
    total = patterns.agg(F.sum("size")).first()[0] or 0
    wanted = targets(sources, total, weights, limit)
    if not patterns.filter(F.size("pattern") > 1).isEmpty():  # overlapping sources: they share the tokens that there are
        whole = wanted.agg(F.sum("target")).first()[0]
        wanted = wanted.withColumn("target", F.col("target") * F.lit(float(total)) / F.lit(max(1.0, whole)))
    plan = flows(patterns, small_side(stage(wanted.withColumnRenamed("s", "_s"), "mix-targets"), 100_000), limit)
    passes = F.when(F.col("size") > 0, F.floor(F.col("flow") / F.col("size"))).otherwise(0).cast("long")
    plan = plan.select("key", "source_size", "target", "n", passes.alias("passes"), (F.col("flow") - passes * F.col("size")).alias("rest"))
    plan = edges(sized.select("key", "u", "size", "copies"), stage(plan, "mix-plan"), slice_docs)
    name = F.when(F.size("pattern") == 1, F.get("pattern", F.lit(0))).otherwise(F.array_join("pattern", "|", "null"))
    dealt = sized.withColumn("source", name).drop("pattern").join(small_side(stage(plan, "mix-edges"), 100_000), "key")
    close = (F.col("rest") > 0) & (F.col("u") >= F.col("low")) & (F.col("u") < F.col("high"))
    columns = ["doc_id", "key", "size", "copies", "passes", "source_size", "target", "source"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filled = dealt.filter(close).repartition(parts, "key").sortWithinPartitions("key", "u", "doc_id", "size").select(*columns, "left")
    filled = filled.mapInPandas(_fill_all, ", ".join(f"{c} {t}" for c, t in filled.dtypes if c != "left") + ", picked long")
    picked = F.when((F.col("rest") > 0) & (F.col("u") < F.col("low")), F.col("copies")).otherwise(F.lit(0)).cast("long")
    return dealt.filter(~close).select(*columns, picked.alias("picked")).unionByName(filled)


def _pattern(docs: DataFrame, source: str) -> Column:
    """The sorted different sources of a row; null stands for none."""
    several = dict(docs.dtypes)[source].startswith("array")
    member = F.array_sort(F.array_distinct(F.col(f"`{source}`").cast("array<string>"))) if several else F.array(F.col(f"`{source}`").cast("string"))
    return F.when(F.coalesce(F.size(member), F.lit(0)) < 1, F.array(F.lit(None).cast("string"))).otherwise(member)


def mix(docs: DataFrame, **options) -> DataFrame:
    """A row per row of ``docs``: doc_id, size, source_size, target, taken, source.

    Needs ``doc_id``, ``text`` and the column that the option ``source`` names
    (``source``), a string or an array of strings for documents in several
    sources; other columns are ignored. A null source is a source of its own,
    the last; an array counts each member once, and an empty one as null.
    Sizes are words (null text: 0). Sources in the order of their code points
    weigh 1, 2, 3, repeating (``weights``). For a document in several sources,
    source_size and target are sums over them. ``taken`` is a whole multiple of
    the size, of 0 to ``limit`` times. Repeated rows are taken separately;
    documents without words are never taken. An empty table gives an empty
    result. There is no limit to the number of sources or patterns; one task
    holds a row for each pattern of sources that overlap.
    """
    # rows that are the same differ at most in whether they are taken once more
    rows = decide(docs, **options)
    thousand = rows.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / 1000))))
    each = F.sequence(F.col("at") * 1000, F.least(F.col("at") * 1000 + 999, F.col("copies") - 1))
    thousand = thousand.withColumn("copy", F.explode(each))
    taken = F.col("size") * (F.col("passes") + (F.col("copy") < F.col("picked")).cast("long"))
    return thousand.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source")


def mixed_documents(docs: DataFrame, *, source: str = "source", broadcast_rows: int = 1_000_000, **options) -> DataFrame:
    """``docs`` as often as the mix takes each, with all columns: none, once or repeatedly.

    Up to ``broadcast_rows`` decisions are sent to the tasks; more are joined
    by shuffling.
    """
    taken = decide(docs, source=source, **options).filter("size > 0 AND passes + picked > 0")
    plan = stage(taken.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("size").alias("_size"), "copies", "passes", "picked"), "mix-taken")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (F.to_json(_pattern(docs, source)) == F.col("_key")) & (word_count(docs["text"].cast("string")) == F.col("_size"))
    columns = [F.col(f"`{c}`") for c in docs.columns]

    def repeated(rows: DataFrame, times: Column) -> DataFrame:
        return rows.withColumn("_times", times.cast("int")).filter("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*columns)

    even = plan.filter("picked = 0 OR picked = copies").select("_id", "_key", "_size", (F.col("passes") + (F.col("picked") > 0).cast("long")).alias("_all"))
    out = repeated(docs.join(small_side(even, broadcast_rows), same), F.col("_all"))
    part = plan.filter("picked > 0 AND picked < copies").select("_id", "_key", "_size", F.col("passes").alias("_all"), F.col("picked").alias("_more"))
    if part.isEmpty():
        return out
    # some of several rows with one id, source and size: those whose text comes first
    order = Window.partitionBy("_id", "_key", "_size").orderBy(F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")), 256))
    numbered = docs.join(small_side(part, broadcast_rows), same).withColumn("_at", F.row_number().over(order))
    return out.unionByName(repeated(numbered, F.col("_all") + (F.col("_at") <= F.col("_more")).cast("long")))
