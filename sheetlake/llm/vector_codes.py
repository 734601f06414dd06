"""Product codes of vectors: codebooks by Lloyd rounds that skip work by Yinyang bounds.

Components become ``floor(4096 * x)`` and a vector is cut into equal parts.
Each part position has a codebook, whose entries are put into groups once. A
part keeps an upper bound of the distance to its own entry and, for each
group, a lower bound of the distance to the group's other entries. After an
update the bounds move by the entries' drift, and only groups whose bound
fails are scanned. Bounds are floating point with a margin and only steer;
distances are integers, and a group that may hold a tie is scanned, so that
ties go to the lower index.

A round is one pass over the rows where they are: no shuffle but that of the
sums, a fixed number for each batch of rows. State goes with the rows from
round to round in a staged table, and the table before it is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import remove, small_side, stage_at

ROWS = 1024  # that are worked at once
SLACK = 1e-6
LARGEST = 2**63 - 1


def number_type(most: int, width: int):
    """Numbers in which squared distances of parts are exact: floats, 64-bit integers or Python's."""
    top = max(1, width) * (2 * (most + 1)) ** 2
    return np.float64 if top < 2**53 else np.int64 if top < 2**63 else object


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances along the last axis."""
    d = x - y
    return (d * d).sum(-1)


def above(d: np.ndarray) -> np.ndarray:
    """A bound not below the root of squared distances."""
    return (np.sqrt(d.astype(np.float64)) * (1 + SLACK)).astype(np.float32)


def below(d: np.ndarray) -> np.ndarray:
    return (np.sqrt(d.astype(np.float64)) * (1 - SLACK)).astype(np.float32)


def grouped(book: np.ndarray, groups: int) -> list[list[int]]:
    """The entries of a codebook in groups of near ones: a few rounds of clustering the entries themselves."""
    points = book.astype(np.float64)
    groups = min(groups, len(points))
    centres = points[np.linspace(0, len(points) - 1, groups).astype(int)]
    own = np.zeros(len(points), int)
    for _ in range(5):
        own = ((points[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        centres = np.array([points[own == g].mean(0) if (own == g).any() else centres[g] for g in range(groups)])
    return [np.flatnonzero(own == g).tolist() for g in range(groups) if (own == g).any()]


class Book:
    """A part position's entries, their groups, and how far entries and groups have moved since the last round."""

    def __init__(self, entries: np.ndarray, groups: list[list[int]], before: np.ndarray | None = None) -> None:
        self.entries, self.groups = entries, groups
        moved = squared(entries, before) if before is not None else np.zeros(len(entries))
        self.drift = above(np.asarray(moved))
        self.group_drift = np.array([self.drift[g].max() for g in groups], np.float32)
        self.group_of = np.zeros(len(entries), int)
        for i, g in enumerate(groups):
            self.group_of[g] = i

    def assign(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, stats: dict | None = None) -> None:
        """Bring ``own``, ``upper`` and ``lower`` of rows ``x`` up to date, in place."""
        upper += self.drift[own]
        upper *= np.float32(1 + SLACK)
        lower -= self.group_drift
        lower -= np.abs(lower) * np.float32(SLACK)
        rows = np.flatnonzero(lower.min(1) <= upper)
        best = squared(x[rows], self.entries[own[rows]])
        upper[rows] = above(best)
        still = lower[rows].min(1) <= upper[rows]
        rows, best = rows[still], best[still]
        if stats is not None:
            stats["scans"] = stats.get("scans", 0)
            stats["all"] = stats.get("all", 0) + len(x) * len(self.groups)
        if not len(rows):
            return
        old, old_best, who = own[rows], best.copy(), own[rows].copy()
        seen = []
        for g, members in enumerate(self.groups):
            at = np.flatnonzero(lower[rows, g] <= above(best))
            if stats is not None:
                stats["scans"] += len(at)
            if not len(at):
                seen.append((at, None))
                continue
            d = squared(x[rows[at]][:, None, :], self.entries[members][None])
            first = d.argmin(1)  # members ascend, so the lower index of equal ones
            d1 = d[np.arange(len(at)), first]
            i1 = np.array(members)[first]
            better = (d1 < best[at]) | ((d1 == best[at]) & (i1 < who[at]))
            who[at[better]], best[at[better]] = i1[better], d1[better]
            seen.append((at, d))
        for g, members in enumerate(self.groups):
            at, d = seen[g]
            left = (self.group_of[old] == g) & (who != old)
            left[at] = False  # where the group was not scanned, the entry that was left is now one of the others
            lower[rows[left], g] = np.minimum(lower[rows[left], g], below(old_best[left]))
            if not len(at):
                continue
            bound = below(d)
            bound[who[at][:, None] == np.array(members)[None, :]] = np.inf
            least = bound.min(1)
            lower[rows[at], g] = np.where(np.isinf(least), np.float32(3e38), least)
        own[rows], upper[rows] = who, above(best)


def _bytes(m: np.ndarray) -> list[bytes]:
    """Each row's bytes."""
    data, wide = np.ascontiguousarray(m).tobytes(), m.shape[1] * m.dtype.itemsize
    return [data[i * wide:(i + 1) * wide] for i in range(len(m))]


def _rows(column: pd.Series, kind, wide: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), wide).copy()


def _padded(lists: list, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), np.int64)
    for i, x in enumerate(lists):
        out[i, :len(x)] = x
    return out


def sums(x: np.ndarray, own: np.ndarray, entries: int) -> np.ndarray:
    """For each entry: parts, and sums of the components' upper and lower halves, which cannot overflow in a batch."""
    ints = x.astype(np.int64)
    out = np.zeros((entries, 1 + 2 * x.shape[1]), np.int64)
    np.add.at(out, own, np.concatenate([np.ones((len(x), 1), np.int64), ints >> 20, ints & ((1 << 20) - 1)], 1))
    return out


def updated(book: np.ndarray, total: list[int]) -> np.ndarray:
    """The entries' new places from summed ``sums``; an unused one stays."""
    d = book.shape[1]
    out = book.copy()
    for e in range(len(book)):
        n, *halves = total[e * (1 + 2 * d):(e + 1) * (1 + 2 * d)]
        if n:
            out[e] = [((halves[j] << 20) + halves[d + j]) // n for j in range(d)]
    return out


def codes(vectors: DataFrame, *, parts: int = 8, entries: int = 16, rounds: int = 6, groups: int = 4, scale: float = 4096.0) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for each usable row of ``vectors`` (vec_id, embedding, label).

    Vectors that are null or hold null or non-finite components are left out;
    of shorter ones the rest counts as zeros, as do places up to a multiple of
    ``parts``. Components beyond 64 bits are clamped to them, as are errors.
    Repeated ids are rows of their own, ordered by their vectors where the
    first codebooks are made; null ids come last. With fewer than ``entries``
    rows there are fewer entries. Other columns are ignored; an empty table
    gives an empty result. Nothing but the codebooks' sums reaches the driver.
    """
    spark = vectors.sparkSession
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    read = vectors.filter(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), whole.alias("v"))
    far = F.greatest(F.array_max("v"), -1 - F.array_min("v"))
    width, most = read.agg(F.max(F.size("v")), F.max(far)).first()
    if width is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    deep = -(-width // parts)
    kind = number_type(most or 0, deep)
    stored = next(t for t in (np.int16, np.int32, np.int64) if (most or 0) <= np.iinfo(t).max)
    start = _padded([r["v"] for r in read.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()], deep * parts)
    books = [start[:, p * deep:(p + 1) * deep].astype(kind) for p in range(parts)]
    sets = [grouped(b, groups) for b in books]
    held = max(map(len, sets))
    state = "vec_id string, label string, v binary, own binary, upper binary, lower binary, sums array<long>"

    def cut(v: np.ndarray, p: int) -> np.ndarray:
        return v[:, p * deep:(p + 1) * deep].astype(kind)

    def assigned(pdf: pd.DataFrame, now: list[Book], first: bool):
        """Vectors and their state after one more assignment, some rows at a time."""
        for at in range(0, len(pdf), ROWS):
            some = pdf.iloc[at:at + ROWS]
            if first:
                v = _padded(some["v"].tolist(), deep * parts)
                own, upper = np.zeros((len(some), parts), np.uint8), np.full((len(some), parts), np.float32(3e38))
                lower = np.zeros((len(some), parts * held), np.float32)
            else:
                v = _rows(some["v"], stored, deep * parts)
                own, upper, lower = _rows(some["own"], np.uint8, parts), _rows(some["upper"], np.float32, parts), _rows(some["lower"], np.float32, parts * held)
            for p, book in enumerate(now):
                mine, up, low = own[:, p].astype(int), upper[:, p].copy(), lower[:, p * held:p * held + len(book.groups)].copy()
                book.assign(cut(v, p), mine, up, low)
                own[:, p], upper[:, p], lower[:, p * held:p * held + len(book.groups)] = mine, up, low
            yield some, v, own, upper, lower

    def turn(now: list[Book], first: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                total = np.zeros((parts, len(books[0]), 1 + 2 * deep), np.int64)
                for some, v, own, upper, lower in assigned(pdf, now, first):
                    for p in range(parts):
                        total[p] += sums(v[:, p * deep:(p + 1) * deep], own[:, p], len(books[0]))
                    yield pd.DataFrame({"vec_id": some["vec_id"].array, "label": some["label"].array, "v": _bytes(v.astype(stored)), "own": _bytes(own), "upper": _bytes(upper), "lower": _bytes(lower), "sums": None})
                if len(pdf):
                    yield pd.DataFrame({"vec_id": [None], "label": [None], "v": [None], "own": [None], "upper": [None], "lower": [None], "sums": [total.reshape(-1)]})
        return run

    def last(now: list[Book]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for some, v, own, _, _ in assigned(pdf, now, rounds == 0):
                    error = sum(squared(cut(v, p), b.entries[own[:, p]]) for p, b in enumerate(now))
                    error = [min(int(e), LARGEST) for e in error]
                    yield pd.DataFrame({"vec_id": some["vec_id"].array, "label": some["label"].array, "code": [bytes(o).hex() for o in own], "error": error})
        return run

    rows, place = read.withColumn("vec_id", F.col("vec_id").cast("string")), None  # texts keep nulls and large numbers whole in pandas
    now = [Book(b, s) for b, s in zip(books, sets)]
    for i in range(rounds):
        staged, where = stage_at(rows.mapInPandas(turn(now, i == 0), state), "codes-round")
        if place:
            remove(spark, place)
        slots = staged.filter("sums IS NOT NULL").select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        total = [0] * (parts * len(books[0]) * (1 + 2 * deep))
        for at, x in slots.collect():  # one number for each component of the codebooks
            total[at] = int(x)
        size = len(total) // parts
        new = [updated(b, total[p * size:(p + 1) * size]) for p, b in enumerate(books)]
        now = [Book(n, s, b) for n, s, b in zip(new, sets, books)]
        books, rows, place = new, staged.filter("sums IS NULL").drop("sums"), where
    done, _ = stage_at(rows.mapInPandas(last(now), "vec_id string, label string, code string, error long"), "codes-final")
    if place:
        remove(spark, place)
    text = ",".join(str(int(x)) for b in books for e in b for x in e)
    summed = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    by_label = small_side(done.groupBy("label").agg(summed.alias("label_error")).withColumnRenamed("label", "_label"), 1_000_000)
    out = done.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return out.select(F.col("vec_id").cast("long").alias("vec_id"), "code", "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))
