"""URL rules and host lists by a cascade of Bloom filters, without a join over the pages.

A listed key is a kind (allow rule, block rule, listed host) with a host and
the start of a path. The corpus's keys are all that its URLs could be listed
under: every host suffix and path start of a size that some listed key has.
Level 1 encodes the listed keys. The corpus's other keys that pass it are
known exactly, as all its keys are tried, so level 2 encodes them, level 3 the
listed keys that pass level 2, and so on until none passes. On the corpus's
keys the cascade is then exact: the first level that a key misses decides.

Keys are dealt to parts by hash. A part's cascade is built by one task from a
bounded number of keys, and only the keys that pass level 1 (the listed ones
and fewer others than those) are ever shuffled.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK, HOST = "+", "-", "!"
MOST_LEVELS = 200


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host in lower case and the path of a URL; both empty for null and without ``://``."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    before = F.regexp_extract(rest, r"\A[^?#]*", 0)
    host = F.regexp_extract(before, r"\A[^/]*", 0)
    return F.translate(host, UPPER, LOWER), F.substring(before, F.length(host) + 1, F.length(before))


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser, different for each seed."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Bloom:
    """A Bloom filter of keys given by two 64-bit hashes; ``level`` makes the positions of each level its own."""

    def __init__(self, level: int, hashes: int, bits: np.ndarray) -> None:
        self.level, self.hashes, self.bits = level, hashes, bits

    @classmethod
    def of(cls, keys: np.ndarray, level: int, passing: float) -> Bloom:
        """A filter that about ``passing`` of the other keys pass."""
        hashes = max(1, math.ceil(-math.log2(passing)))
        size = max(64, math.ceil(len(keys) * hashes / math.log(2)))
        made = cls(level, hashes, np.zeros((size + 7) // 8, np.uint8))
        for at in made.places(keys):
            np.bitwise_or.at(made.bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        return made

    def places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        start, step = _mixed(keys[:, 0], self.level), _mixed(keys[:, 1], self.level) | np.uint64(1)
        for j in range(self.hashes):
            with np.errstate(over="ignore"):
                yield _mixed(start + np.uint64(j) * step, j) % np.uint64(len(self.bits) * 8)

    def passes(self, keys: np.ndarray) -> np.ndarray:
        ok = np.ones(len(keys), bool)
        for at in self.places(keys):
            ok &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
        return ok

    def to_bytes(self) -> bytes:
        return struct.pack("<IIQ", self.level, self.hashes, len(self.bits)) + self.bits.tobytes()


class Cascade:
    """Levels of filters; the first one that a key misses decides."""

    def __init__(self, levels: list[Bloom]) -> None:
        self.levels = levels

    @classmethod
    def extended(cls, first: Bloom, listed: np.ndarray, others: np.ndarray) -> Cascade:
        """The levels below ``first``, which ``listed`` are in and ``others`` pass without being in."""
        levels, inside, outside = [first], others, listed
        while len(inside):
            if len(levels) >= MOST_LEVELS:  # two keys with the same 128 bits, one of them listed
                raise ValueError("a listed and another key have the same hashes")
            levels.append(Bloom.of(inside, len(levels) + 1, 0.5))
            inside, outside = outside[levels[-1].passes(outside)], inside
        return cls(levels)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros(len(keys), bool), np.arange(len(keys))
        for i, level in enumerate(self.levels):
            ok = level.passes(keys[open_])
            out[open_[~ok]] = i % 2 == 1
            open_ = open_[ok]
        out[open_] = len(self.levels) % 2 == 1
        return out

    def to_bytes(self) -> bytes:
        return b"".join(x.to_bytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> Cascade:
        levels, at = [], 0
        while at < len(data):
            level, hashes, size = struct.unpack_from("<IIQ", data, at)
            levels.append(Bloom(level, hashes, np.frombuffer(data, np.uint8, size, at + 16)))
            at += 16 + size
        return cls(levels)


def _pairs(first, second) -> np.ndarray:
    return np.stack([np.asarray(first, np.int64).view(np.uint64), np.asarray(second, np.int64).view(np.uint64)], 1)


def _hashed(df: DataFrame, parts: int) -> DataFrame:
    """``df`` (key, ...) with two hashes and the key's part."""
    h = F.xxhash64("key", F.lit(1))
    return df.withColumns({"h1": h, "h2": F.xxhash64("key", F.lit(2)), "part": F.pmod(h, F.lit(parts)).cast("int")})


def _passing(cascades, parts: int):
    """A function of two arrays of hashes: which keys are held by the broadcast ``cascades`` (part -> bytes)."""
    made: dict[int, Cascade] = {}

    @F.pandas_udf("array<boolean>")
    def passing(first: pd.Series, second: pd.Series) -> pd.Series:
        sizes = [len(x) for x in first]
        if not sum(sizes):
            return pd.Series([[] for _ in sizes], dtype=object)
        keys = _pairs(np.concatenate(first.tolist()), np.concatenate(second.tolist()))
        part = np.concatenate(first.tolist()).astype(np.int64) % parts
        out = np.zeros(len(keys), bool)
        for p in np.unique(part).tolist():
            if p in cascades.value:
                if p not in made:
                    made[p] = Cascade.from_bytes(cascades.value[p])
                at = np.flatnonzero(part == p)
                out[at] = made[p].holds(keys[at])
        ends = np.cumsum(sizes)[:-1]
        return pd.Series([x.tolist() for x in np.split(out, ends)], dtype=object)

    return passing


def _groups(table: DataFrame, most_bytes: int) -> list[list[int]]:
    """Parts of ``table`` (part, data) in groups of ``most_bytes`` at most; one number for each part is read."""
    out, held = [[]], 0
    for part, size in table.select("part", F.length("data")).orderBy("part").collect():
        if out[-1] and held + size > most_bytes:
            out.append([])
            held = 0
        out[-1].append(part)
        held += size
    return out


def _held(rows: DataFrame, table: DataFrame, parts: int, most_bytes: int, name: str) -> DataFrame:
    """``rows`` (keys, ...) with ``found``, the keys that the cascades of ``table`` hold; a pass for each group of parts."""
    spark = rows.sparkSession
    hashes = [F.transform("keys", lambda k: F.xxhash64(k, F.lit(1))), F.transform("keys", lambda k: F.xxhash64(k, F.lit(2)))]
    rows = rows.withColumn("found", F.array().cast("array<string>"))
    groups = _groups(table, most_bytes)
    for i, group in enumerate(groups):
        data = {r["part"]: bytes(r["data"]) for r in table.filter(F.col("part").isin(group)).collect()}
        passing = _passing(spark.sparkContext.broadcast(data), parts)
        rows = rows.withColumn("ok", passing(*hashes))
        here = F.transform(F.filter(F.arrays_zip(F.col("keys").alias("k"), F.col("ok").alias("ok")), lambda z: z["ok"]), lambda z: z["k"])
        rows = rows.withColumn("found", F.concat("found", here)).drop("ok")
        if i + 1 < len(groups):  # the next group's filters are another stage's
            rows = stage(rows, f"{name}-{i}")
    return rows


def listed_keys(rules: DataFrame, hosts: DataFrame) -> DataFrame:
    """key, labels, size for rules (host, path, verdict) and listed hosts (host).

    Hosts become lower case. Rules without a host, and those whose path does
    not start with ``/`` (an empty path fits all), fit no URL and are left
    out, as are other verdicts than allow and block and empty hosts.
    """
    low = F.translate(F.col("host"), UPPER, LOWER)
    kind = F.when(F.col("verdict") == "allow", ALLOW).when(F.col("verdict") == "block", BLOCK)
    path = F.coalesce(F.col("path"), F.lit(""))
    own = rules.filter((path == "") | path.startswith("/")).select(kind.alias("kind"), low.alias("host"), path.alias("path"))
    own = own.unionByName(hosts.select(F.lit(HOST).alias("kind"), low.alias("host"), F.lit("").alias("path")))
    own = own.filter("kind IS NOT NULL AND host <> '' AND NOT contains(host, '/')")
    return own.select("kind", F.concat("kind", "host", "path").alias("key"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("size")).distinct()


def candidate_keys(host: Column, path: Column, shapes: list[tuple[str, int, int]]) -> Column:
    """The keys of one URL: a host suffix of so many labels and a path start of so many code points for each shape."""
    every = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("n"), F.lit(s).alias("s")) for k, n, s in shapes])
    labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    fit = F.filter(every, lambda z: (z["n"] <= labels) & (z["s"] <= F.length(path)))
    return F.transform(fit, lambda z: F.concat(z["k"], F.call_function("substring_index", host, F.lit("."), -z["n"]), F.substring(path, F.lit(1), z["s"])))


def judge(pages: DataFrame, rules: DataFrame, hosts: DataFrame, *, part_keys: int = 65536, most_bytes: int = 64 << 20) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages`` (page_id, url).

    The longest rule that fits gives the verdict: its host is the URL's or a
    parent domain of it, and the URL's path starts with its path. Of rules
    equally long the one with the longer host counts, and of equal ones block.
    Without a rule, a listed host and its subdomains are blocked and all else
    is allowed. Null URLs and those without ``://`` have an empty host and
    path and are allowed. Repeated rows each get a row; other columns are
    ignored; an empty table gives an empty result, and empty lists allow all.

    The driver holds one row for each shape (kind, labels of the host, size
    of the path) and part of the lists, and the tasks ``most_bytes`` of
    filters at once; longer lists take several passes over the pages.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    listed = stage(listed_keys(rules, hosts), "urls-listed")
    shapes = [(r["kind"], r["labels"], r["size"]) for r in listed.groupBy("kind", "labels", "size").count().orderBy("kind", "labels", "size").collect()]
    if not shapes:
        return urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    rows = urls.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), shapes))
    universe = rows.select(F.explode("keys").alias("key"))
    n = listed.count()
    others = max(1, universe.agg(F.approx_count_distinct("key")).first()[0])  # sizes the first level only
    parts = max(1, math.ceil(n / part_keys))
    passing = min(0.5, max(2.0**-30, n * math.sqrt(0.5) / others))

    def first_level(keys: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": keys["part"].iloc[:1], "data": [Bloom.of(_pairs(keys["h1"], keys["h2"]), 1, passing).to_bytes()]})

    def all_levels(part: tuple, keys: pd.DataFrame, first: pd.DataFrame) -> pd.DataFrame:
        both, mine = _pairs(keys["h1"], keys["h2"]), keys["listed"].to_numpy(bool)
        top = Cascade.from_bytes(bytes(first["data"].iloc[0])).levels[0]
        return pd.DataFrame({"part": [part[0]], "data": [Cascade.extended(top, both[mine], both[~mine]).to_bytes()]})

    made = "part int, data binary"  # a part is a bounded number of distinct keys, dealt by hash
    level1 = stage(_hashed(listed.select("key"), parts).select("part", "h1", "h2").groupBy("part").applyInPandas(first_level, made), "urls-level1")
    # the whole universe is tried; only what passes is made distinct and looked up in the lists
    passed = _held(rows.select("keys"), level1, parts, most_bytes, "urls-tried").select(F.explode("found").alias("key")).distinct()
    known = passed.join(listed.select("key", F.lit(True).alias("listed")), "key", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    keyed = _hashed(known, parts).select("part", "h1", "h2", "listed")
    cascades = stage(keyed.groupBy("part").cogroup(level1.groupBy("part")).applyInPandas(all_levels, made), "urls-cascades")

    judged = _held(rows, cascades, parts, most_bytes, "urls-judged")
    fit = F.transform(F.filter("found", lambda k: ~k.startswith(HOST)), lambda k: F.struct(F.length(k).alias("size"), F.instr(F.concat(k, F.lit("/")), "/").alias("host"), F.substring(k, 1, 1).alias("kind"), F.substring(k, F.lit(2), F.length(k)).alias("text")))
    on_list = F.exists("found", lambda k: k.startswith(HOST))
    judged = judged.select("page_id", "host", "path", F.array_max(fit).alias("best"), on_list.alias("on_list"))
    verdict = F.when(F.col("best.kind") == ALLOW, "allow").when((F.col("best.kind") == BLOCK) | F.col("on_list"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("best.text").alias("rule"), verdict.alias("verdict"))


#: The rules of the query, as fixed by its contract.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: A label of a host with one of these words, between hyphens or alone, is listed with what follows it.
LISTED_WORDS = ("bets", "casino", "pills", "spam")
LISTED_HOST = rf"(?:^|\.)((?:[^.]*-)?(?:{'|'.join(LISTED_WORDS)})(?:-[^.]*)?\.[^/]*)\z"


def listed_hosts(pages: DataFrame) -> DataFrame:
    """host: the pages' hosts from the label on that has a listed word."""
    host, _ = host_and_path(F.col("url"))
    return pages.select(F.regexp_extract(host, LISTED_HOST, 1).alias("host")).filter("host <> ''").distinct()


def judge_pages(pages: DataFrame) -> DataFrame:
    """``judge`` with ``RULES`` and the hosts of ``listed_hosts``."""
    rules = pages.sparkSession.createDataFrame(list(RULES), "host string, path string, verdict string")
    return judge(pages, rules, listed_hosts(pages))
