"""Exact top-k inner products by best-first search in M-trees.

Components become ``floor(1024 * x)``. With M the largest norm, a vector x
becomes the point (x, sqrt(M^2 - |x|^2)) and a query q the point (q, 0): the
Euclidean distance then falls as the inner product rises, so a metric tree
serves. The top of the tree is a page of routing vectors: each row belongs to
the nearest one, whose covering radius says how far its rows may be. Below it
each region is one shard or, where it is large, several, and each shard is a
tree of paged nodes with covering radii and distances to the parent. A query
goes to the shards of the regions that can hold one of its k best, given k
scores that are known beforehand from the routing rows. Each row is moved
once; a shard's tree is built once, and queries go through it many at a time:
each takes its leaf pages in the order of their least distances until none can
matter, and a page is multiplied at once with all queries that have come to it.
Floating-point distances only steer the search, with a margin; scores are
integers.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

PAGE = 128

#: Queries that go through a shard together, and candidates that they gather before these are cut to the best.
TOGETHER, GATHERED = 512, 1 << 20


class Node:
    """A page: centres of entries, their radii, their distances to this page's own centre (ascending in a leaf), and what they lead to."""

    __slots__ = ("points", "radii", "to_parent", "children", "items", "least")

    def __init__(self, points, radii, to_parent, children, items, least):
        self.points, self.radii, self.to_parent, self.children, self.items, self.least = points, radii, to_parent, children, items, least


def build(points: np.ndarray, least_ids: np.ndarray, page: int = PAGE) -> tuple[Node, np.ndarray]:
    """Bulk-load a tree over rows of ``points``; returns the root page and the point its distances refer to."""

    def halved(items: np.ndarray, parts: int) -> list[np.ndarray]:
        """Parts of equal size: cut across the line between two far points, again and again."""
        if parts == 1:
            return [items]
        x = points[items]
        far = x[((x - x.mean(0)) ** 2).sum(1).argmax()]
        order = np.argsort(x @ (x[((x - far) ** 2).sum(1).argmax()] - far), kind="stable")
        cut = len(items) * (parts // 2) // parts
        return halved(items[order[:cut]], parts // 2) + halved(items[order[cut:]], parts - parts // 2)

    def load(items: np.ndarray, centre: np.ndarray) -> Node:
        to = np.sqrt(np.maximum(((points[items] - centre) ** 2).sum(1), 0))
        if len(items) <= page:
            near_first = np.argsort(to, kind="stable")
            items, to = items[near_first], to[near_first]
            return Node(points[items], np.zeros(len(items)), to, None, items, least_ids[items])
        # equal parts, so that no page is left with a few rows; each is led to by the row nearest its middle
        parts = [(x[((points[x] - points[x].mean(0)) ** 2).sum(1).argmin()], x) for x in halved(items, min(page, math.ceil(len(items) / page)))]
        centres = points[[p for p, _ in parts]]
        children = [load(x, points[p]) for p, x in parts]
        radii = np.array([np.sqrt(((points[x] - points[p]) ** 2).sum(1)).max() for p, x in parts])
        return Node(centres, radii, np.sqrt(((centres - centre) ** 2).sum(1)), children, None, np.array([c.least.min() for c in children]))

    centre = points.mean(0)
    return load(np.arange(len(points)), centre), centre


def search(root: Node, centre: np.ndarray, point: np.ndarray, score_of, ids: list[np.ndarray], own: int, k: int, base: float, stats: dict, floor: float = -math.inf) -> list[tuple[int, int]]:
    """The k best (score, id) for a query point: highest score, ties to the smaller id; ``own`` is left out.

    ``base`` is |q|^2 + M^2, so that a score s stands for the squared distance
    base - 2 s. Candidates below ``floor`` need not be found.
    """
    best: list[tuple[int, int]] = []  # a heap with the worst on top: (score, -id)
    slack = 1e-9 * (base + 1) + 1e-6

    def bound() -> float:
        least = floor if len(best) < k else max(floor, float(best[0][0]))
        return math.inf if least == -math.inf else math.sqrt(max(base - 2 * least, 0.0) + slack) + 1e-9 * math.sqrt(base + 1)

    pages = [(0.0, 0, root, float(np.sqrt(((point - centre) ** 2).sum())))]
    count = 0
    while pages:
        low, _, node, to_centre = heapq.heappop(pages)
        if low > bound():
            break
        # the triangle inequality on stored distances rules entries out before any distance is computed
        near = np.abs(to_centre - node.to_parent) - node.radii <= bound()
        stats["skipped"] += int(len(near) - near.sum())
        stats["computed"] += int(near.sum())
        if not near.any():
            continue
        at = np.flatnonzero(near)
        if node.items is not None:
            scores = score_of(node.items[at])
            ok = np.arange(len(at)) if len(best) < k else np.flatnonzero(scores >= best[0][0])
            if not len(ok):
                continue
            least = node.least[at[ok]]
            if scores.dtype == object:
                order = ok[sorted(range(len(ok)), key=lambda j: (-scores[ok[j]], least[j]))]
            else:
                order = ok[np.lexsort((least, -scores[ok]))]
            counted = 0
            for j in order:
                s = int(scores[j])
                if counted == k or len(best) == k and s < best[0][0]:
                    break
                held = ids[node.items[at[j]]]
                # a vector whose least id is another's gives a candidate before all of the following vectors
                counted += int(held[0] != own)
                if len(held) > 1:
                    a, b = np.searchsorted(held, own), np.searchsorted(held, own, "right")
                    held = (*held[: min(a, k)], *held[b : b + k])
                for v in held:
                    v = int(v)
                    if v == own:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (s, -v))
                    elif (s, -v) > best[0]:
                        heapq.heapreplace(best, (s, -v))
                    else:
                        break
            continue
        d = np.sqrt(np.maximum(((node.points[at] - point) ** 2).sum(1), 0))
        lows = np.maximum(d - node.radii[at], 0)
        limit = bound()
        for j, x, dist in zip(at, lows, d):
            if x <= limit:
                count += 1
                heapq.heappush(pages, (float(x), count, node.children[j], float(dist)))
    return sorted(((s, -v) for s, v in best), key=lambda r: (-r[0], r[1]))


def leaf_pages(root: Node, centre: np.ndarray, points: np.ndarray, limits: np.ndarray, stats: dict) -> tuple[list[Node], np.ndarray, np.ndarray]:
    """The leaf pages that any query can need; for each query its distance from their centres, and the least one from their rows (infinite: ruled out)."""
    found: list[tuple[Node, np.ndarray, np.ndarray, np.ndarray]] = []
    squares = (points**2).sum(1)
    open_ = [(root, np.arange(len(points)), np.sqrt(((points - centre) ** 2).sum(1)), np.zeros(len(points)))]
    while open_:
        node, who, to_centre, low = open_.pop()
        if node.items is not None:
            found.append((node, who, to_centre, low))
            continue
        # the triangle inequality on stored distances rules entries out before any distance is computed
        near = np.abs(to_centre[:, None] - node.to_parent[None]) - node.radii[None] <= limits[who][:, None]
        at = np.flatnonzero(near.any(0))
        stats["computed"] += len(at) * len(who)
        stats["skipped"] += (near.shape[1] - len(at)) * len(who)
        if not len(at):
            continue
        centres = node.points[at]
        d = np.sqrt(np.maximum(squares[who][:, None] - 2 * points[who] @ centres.T + (centres**2).sum(1)[None], 0))
        lows = np.maximum(d - node.radii[at][None], 0)
        ok = near[:, at] & (lows <= limits[who][:, None])
        for j, child in enumerate(at):
            mine = np.flatnonzero(ok[:, j])
            if len(mine):
                open_.append((node.children[child], who[mine], d[mine, j], lows[mine, j]))
    to, low = np.zeros((len(points), len(found))), np.full((len(points), len(found)), np.inf)
    for j, (_, who, far, least) in enumerate(found):
        to[who, j], low[who, j] = far, least
    return [f[0] for f in found], to, low


def search_many(root: Node, centre: np.ndarray, queries: np.ndarray, exact: np.ndarray, least_ids: np.ndarray, own: np.ndarray, k: int, bases: np.ndarray, floors: np.ndarray, stats: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For many queries the vectors that can hold their k best ids: query, vector, score, in the order of these, scores falling, least ids rising.

    ``exact`` has the vectors, in a kind of number that holds any sum of
    products exactly, as ``queries`` has. A vector whose least id is the
    query's own does not count towards the k. The other arguments are those of
    ``search``, an entry for each query.
    """
    kind = exact.dtype
    most = 2.0**24 if kind == np.float32 else 2.0**53
    asked = queries.astype(kind)
    points = np.hstack([queries, np.zeros((len(queries), 1))])
    slack = 1e-9 * (bases + 1) + 1e-6
    reach = floors.astype(float).copy()

    def limits() -> np.ndarray:
        known = np.where(np.isinf(reach), 0, reach)
        return np.where(np.isinf(reach), np.inf, np.sqrt(np.maximum(bases - 2 * known, 0) + slack) + 1e-9 * np.sqrt(bases + 1))

    limit = limits()
    pages, to, low = leaf_pages(root, centre, points, limit, stats)
    order = np.argsort(low, axis=1, kind="stable")
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind))

    def cut(best, new):
        """The k best of each query, and how far it now reaches."""
        q, v, s = (np.concatenate(x) for x in zip(best, *new))
        by = np.lexsort((least_ids[v], -s, q))
        q, v, s = q[by], v[by], s[by]
        counts = least_ids[v] != own[q]
        before = np.cumsum(counts) - counts
        before -= before[np.searchsorted(q, q)]
        last = counts & (before == k - 1)
        reach[q[last]] = np.maximum(reach[q[last]], s[last])
        keep = before < k
        return q[keep], v[keep], s[keep]

    at, step = 0, 1
    while at < len(pages):
        some = order[:, at:at + step]
        q, c = np.nonzero(np.take_along_axis(low, some, 1) <= limit[:, None])
        if not len(q):
            break  # the pages after these are farther still
        p = some[q, c]
        by = np.argsort(p, kind="stable")
        q, p = q[by], p[by]
        first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        new, gathered = [], 0
        for a, b in zip(first, np.r_[first[1:], len(p)]):
            node, who = pages[p[a]], q[a:b]
            far, span = to[who, p[a]], limit[who]
            i, j = np.searchsorted(node.to_parent, (far - span).min()), np.searchsorted(node.to_parent, (far + span).max(), "right")
            stats["computed"] += int(j - i) * len(who)
            stats["skipped"] += (len(node.items) - int(j - i)) * len(who)
            if i == j:
                continue
            stats["products"] = stats.get("products", 0) + 1
            items = node.items[i:j]
            scores = asked[who] @ exact[items].T
            r, x = np.nonzero(scores >= np.clip(np.ceil(reach[who]), -most, most).astype(kind)[:, None])
            new.append((who[r], items[x], scores[r, x]))
            gathered += len(r)
            if gathered > GATHERED:
                best, new, gathered = cut(best, new), [], 0
        if new:
            best = cut(best, new)
        limit = limits()
        at, step = at + step, 2 * step
    return best


def _matrix(lists: list, width: int, kind=np.int64) -> np.ndarray:
    """Rows of ``width`` numbers, shorter ones padded with zeros and longer ones cut."""
    if lists and all(len(x) == width for x in lists):
        return np.array(lists, dtype=kind).reshape(len(lists), width)
    out = np.zeros((len(lists), width), dtype=kind)
    for i, x in enumerate(lists):
        out[i, :min(len(x), width)] = x[:width]
    return out


def _unpacked(packed: list[bytes], kind: str, width: int) -> np.ndarray:
    """The matrix of vectors that are their numbers' bytes."""
    if packed and all(len(b) == width * np.dtype(kind).itemsize for b in packed):
        return np.frombuffer(b"".join(packed), kind).reshape(len(packed), width).astype(np.int64)
    return _matrix([np.frombuffer(b, kind) for b in packed], width)


class Shard:
    """The tree of some rows (vec_id, v)."""

    def __init__(self, row_ids: np.ndarray, vectors: list | np.ndarray) -> None:
        every = vectors if isinstance(vectors, np.ndarray) else _matrix(vectors, max(map(len, vectors)))
        self.width = every.shape[1]
        order = np.argsort(row_ids, kind="stable")
        texts = np.fromiter((r.tobytes() for r in every[order]), object, len(every))
        place: dict[bytes, int] = {}
        inverse = np.fromiter((place.setdefault(t, len(place)) for t in texts), np.int64, len(texts))
        by = np.argsort(inverse, kind="stable")
        self.flat, self.counts = row_ids[order][by].astype(np.int64), np.bincount(inverse)
        self.starts = np.cumsum(self.counts) - self.counts
        self.least = self.flat[self.starts]
        self.ids = np.split(self.flat, self.starts[1:])
        unique = self.ints = every[order][by][self.starts]
        self.top = float(np.abs(unique.astype(float)).max(initial=0))
        norms = (unique.astype(float) ** 2).sum(1)
        self.largest = float(norms.max())
        points = np.hstack([unique.astype(float), np.sqrt(np.maximum(self.largest - norms, 0))[:, None]])
        self.root, self.centre = build(points, self.least)
        self.exact: dict[type, np.ndarray] = {}

    def find(self, query, own: int, k: int, stats: dict, floor: float = -math.inf) -> list[tuple[int, int]]:
        """The k best (score, id). What the query has beyond the rows' width meets zeros."""
        q = _matrix([query], self.width)[0]
        qf = q.astype(float)
        exact = self.top * float(np.abs(qf).max(initial=0)) * max(self.width, 1) < 2**62
        ints, qi = (self.ints, q) if exact else (self.ints.astype(object), q.astype(object))
        base = float((qf**2).sum()) + self.largest
        return search(self.root, self.centre, np.append(qf, 0.0), lambda at: ints[at] @ qi, self.ids, own, k, base, stats, floor)

    def find_many(self, queries: np.ndarray, own: np.ndarray, k: int, stats: dict, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best as arrays: number of the query, id, score. Queries are as wide as the rows."""
        norms = (queries.astype(float) ** 2).sum(1)
        # by Cauchy and Schwarz no sum of products, whole or partial, is beyond the norms' product
        most = math.sqrt(self.largest * float(norms.max(initial=0)))
        if most >= 2**52:  # too large for sums of floating-point numbers to be exact
            found = [(i, v, max(min(s, 2**63 - 1), -(2**63))) for i, q in enumerate(queries) for s, v in self.find(q, int(own[i]), k, stats, float(floors[i]))]
            return tuple(np.array(x, np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        kind = np.float32 if most < 2**23 and max(self.largest, float(norms.max(initial=0))) < 2**46 else np.float64
        if kind not in self.exact:
            self.exact[kind] = self.ints.astype(kind)
        q, v, s = search_many(self.root, self.centre, queries.astype(float), self.exact[kind], self.least, own, k, norms + self.largest, floors, stats)
        s = s.astype(np.int64)
        one = self.counts[v] == 1
        parts = [(q[one], self.least[v[one]], s[one])]
        for i in np.flatnonzero(~one):  # equal vectors: k smaller and k larger ids than the query's own at most
            held = self.ids[v[i]]
            a, b = np.searchsorted(held, own[q[i]]), np.searchsorted(held, own[q[i]], "right")
            held = np.concatenate([held[:min(a, k)], held[b:b + k]])
            parts.append((np.full(len(held), q[i]), held, np.full(len(held), s[i])))
        q, ids, s = (np.concatenate(x) for x in zip(*parts))
        other = ids != own[q]
        q, ids, s = q[other], ids[other], s[other]
        by = np.lexsort((ids, -s, q))
        q, ids, s = q[by], ids[by], s[by]
        first = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[first], ids[first], s[first]

    def answers(self, asked: pd.DataFrame, k: int, stats: dict) -> pd.DataFrame:
        """The k best of this shard for each query (vec_id, v as a list or a row of ``width`` numbers, and n and floor if there are any)."""
        own = asked["vec_id"].to_numpy(np.int64)
        times = np.minimum(asked["n"].to_numpy(np.int64), k) if "n" in asked else np.ones(len(asked), np.int64)
        floors = asked["floor"].to_numpy(float) if "floor" in asked else np.full(len(asked), -math.inf)
        vectors, out = asked["v"].tolist(), []
        for at in range(0, len(asked), TOGETHER):
            some = slice(at, at + TOGETHER)
            q, ids, s = self.find_many(_matrix(vectors[some], self.width), own[some], k, stats, floors[some])
            often = times[some][q]
            out.append(pd.DataFrame({"query_id": np.repeat(own[some][q], often), "vec_id": np.repeat(ids, often), "score": np.repeat(s, often)}))
        return pd.concat(out)


def search_shard(rows: pd.DataFrame, queries: pd.DataFrame, k: int, stats: dict | None = None) -> pd.DataFrame:
    """The k best of one shard for each query."""
    stats = {"skipped": 0, "computed": 0} if stats is None else stats
    if not len(rows) or not len(queries):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
    return Shard(rows["vec_id"].to_numpy(), rows["v"].tolist()).answers(queries, k, stats)


class Routing:
    """The top page: routing vectors, and rows whose scores say beforehand what a query can expect."""

    def __init__(self, sample: list[tuple[int, list[int]]], fan: int, width: int, largest: float) -> None:
        self.width, self.largest = width, largest
        self.sample_ids = np.array([i for i, _ in sample], np.int64)
        self.sample = _matrix([v for _, v in sample], width).astype(float)
        _, first = np.unique(self.sample, axis=0, return_index=True)
        self.at = np.sort(first)[:fan]
        self.points = self.sample[self.at]
        self.lift = self._lifted(self.points)
        self.radius = np.zeros(len(self.at))

    def _lifted(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.largest - (x**2).sum(1), 0))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The region of each row, and its distance from the routing vector, rounded up."""
        d = 2 * self.largest - 2 * (x @ self.points.T + np.outer(self._lifted(x), self.lift))
        region = d.argmin(1)
        return region, np.sqrt(np.maximum(d[np.arange(len(x)), region], 0) + 1e-9 * (self.largest + 1))

    def floors(self, q: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
        """What k sampled rows of other ids reach at least; minus infinity with fewer of them."""
        if len(self.sample) < k:
            return np.full(len(q), -np.inf)
        scores = q @ self.sample.T
        scores[np.asarray(own)[:, None] == self.sample_ids[None]] = -np.inf
        out = np.partition(scores, len(self.sample) - k, axis=1)[:, len(self.sample) - k]
        return out - 1e-12 * ((q**2).sum(1) + self.largest) - 1e-9

    def reachable(self, q: np.ndarray, floors: np.ndarray) -> np.ndarray:
        """For each query and region, whether the covering radius leaves room for a score of ``floors``."""
        base = (q**2).sum(1) + self.largest
        slack = 1e-9 * (base + 1) + 1e-6
        d = np.sqrt(np.maximum(base[:, None] - 2 * (q @ self.points.T), 0))
        with np.errstate(invalid="ignore"):
            most = np.where(np.isinf(floors), np.inf, np.sqrt(np.maximum(base - 2 * np.where(np.isinf(floors), 0, floors), 0) + slack))
        return d - self.radius[None, :] - np.sqrt(slack)[:, None] <= most[:, None]


def top_k(vectors: DataFrame, *, k: int = 10, query_every: int = 100, shard_rows: int = 32768, min_shards: int = 12, sample_rows: int = 2048, most_regions: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score for every row whose vec_id is divisible by ``query_every``.

    Needs ``vec_id`` and ``embedding``; other columns are ignored. Rows whose
    vector is null, or holds null or non-finite components, or whose id is
    null take no part. Shorter vectors count as padded with zeros; empty ones
    score 0. Repeated ids are separate candidates, but never for a query with
    that id. The candidates of all rows of a repeated query id are ranked
    together, as often as the rows score them. With fewer than k
    candidates all are returned. Scores beyond 64 bits are clamped to them. An
    empty table gives an empty result. A task holds one shard of about
    ``shard_rows`` rows and a batch of queries, at any size of the input. The
    driver holds ``sample_rows`` rows, from which the ``most_regions`` routing
    vectors at most are taken; all rows are indexed, and the result is exact.
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(1024.0) * x.cast("double")).cast("long"))
    read = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    read = read.select("vec_id", whole.alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, width, largest = read.agg(F.count("*"), F.max(F.size("v")), F.max(norm)).first()
    spark = vectors.sparkSession
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    picked = read.orderBy(F.xxhash64("vec_id", "v", F.lit(7)), "vec_id").limit(sample_rows).collect()
    regions = min(most_regions, max(min_shards, math.ceil(n / shard_rows)))
    routing = Routing([(r["vec_id"], r["v"]) for r in picked], regions, width, largest * (1 + 1e-9))

    # vectors travel as the bytes of the shortest whole numbers that hold them
    size = math.sqrt(largest) + 1
    packed = "<i2" if size < 2**15 else "<i4" if size < 2**31 else "<i8"

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                vectors = pdf["v"].tolist()
                region, far = routing.nearest(_matrix(vectors, width, float))
                yield pdf.assign(v=[np.asarray(x, packed).tobytes() for x in vectors], region=region.astype("int32"), far=far)

    placed = stage(read.mapInPandas(place, "vec_id long, v binary, region int, far double"), "topk-rows")
    # one number of rows and one radius for each region: a bounded table
    held = {r["region"]: (r["n"], r["far"]) for r in placed.groupBy("region").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    shards, first = {}, 0
    for region, (rows, far) in sorted(held.items()):
        routing.radius[region] = far
        shards[region] = (first, math.ceil(rows / shard_rows))
        first += shards[region][1]
    asked = placed.filter(F.pmod("vec_id", F.lit(query_every)) == 0).groupBy("vec_id", "v").agg(F.count("*").alias("n"))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                some = pdf.iloc[at:at + 256]
                q = _unpacked(some["v"].tolist(), packed, width).astype(float)
                floors = routing.floors(q, some["vec_id"].to_numpy(), k)
                open_ = routing.reachable(q, floors)
                rows, tasks = [], []
                for i, ok in enumerate(open_):
                    for region in np.flatnonzero(ok).tolist():
                        start, count = shards.get(region, (0, 0))
                        rows += [i] * count
                        tasks += range(start, start + count)
                out = some.iloc[rows]
                yield pd.DataFrame({"task": np.array(tasks, "int32"), "kind": 1, "vec_id": out["vec_id"].array, "v": out["v"].array, "n": out["n"].array, "floor": floors[rows]})

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, held_, shard = [], [], None
        for pdf in batches:
            rows = pdf[pdf["kind"] == 0]
            ids.append(rows["vec_id"].to_numpy())
            held_ += rows["v"].tolist()
            queries = pdf[pdf["kind"] == 1]
            if len(queries) and (held_ or shard):
                if shard is None:  # rows come before queries
                    shard = Shard(np.concatenate(ids), _unpacked(held_, packed, width))
                    ids, held_ = [], []
                yield shard.answers(queries.assign(v=list(_unpacked(queries["v"].tolist(), packed, width))), k, {"skipped": 0, "computed": 0})

    where = spark.createDataFrame([(r, a, c) for r, (a, c) in shards.items()], "region int, first int, count int")
    task = (F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), F.col("count"))).cast("int")
    rows = placed.join(F.broadcast(where), "region").select(task.alias("task"), F.lit(0).alias("kind"), "vec_id", "v", F.lit(1).cast("long").alias("n"), F.lit(0.0).alias("floor"))
    # a stated query set against all rows
    questions = asked.mapInPandas(ask, "task int, kind int, vec_id long, v binary, n long, floor double")
    dealt = rows.unionByName(questions).repartitionById(first, "task").sortWithinPartitions("kind")
    found = dealt.select("kind", "vec_id", "v", "n", "floor").mapInPandas(answer, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
