"""N-gram Jaccard join by prefix filters under several global orders.

A set of size n that is to reach similarity t with another must share a token
with it among its first ``n - ceil(t * n) + 1`` under *every* global order of
tokens. The first order here puts rare tokens before frequent ones (levels of
the corpus frequency); the others are scattered. The first order
makes the candidates. Every class carries marks of its prefix tokens under
each other order, and bits of all its tokens: a candidate pair goes on
only if its prefixes may meet under each order and its tokens overlap enough,
and the sets of what is left are fetched and compared. Documents with equal sets are one
class throughout, and pairs that are connected already need no verification:
stars around the best-connected class of each bucket come first, a few rounds
of them, and only then all pairs that are still apart. A group of near copies
so costs a few stars and not a square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .memory import release
from .shingles import class_id, mix, shingle_sets
from .staging import small_side, stage

#: Other orders that a candidate must pass.
MORE_ORDERS = (101, 202)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _levels(values: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    tokens, levels = frequent
    if not len(tokens):
        return np.zeros(len(values), np.uint8)
    at = np.minimum(np.searchsorted(tokens, values), len(tokens) - 1)
    return np.where(tokens[at] == values, levels[at], 0).astype(np.uint8)


def prefix(values: np.ndarray, levels: np.ndarray, salt: int, percent: int) -> np.ndarray:
    """The tokens of the prefix under the order (level, scattered token)."""
    p = prefix_length(len(values), percent)
    return values[np.lexsort((mix(values, salt), levels))[:p]]


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def bitmap(values: np.ndarray) -> bytes:
    """Parities of the numbers of tokens by a hash, in two to four times as many bits as tokens."""
    bits = max(6, len(values).bit_length() + 1)
    counts = np.bincount((mix(values, 303) & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _fold(x: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (last axis) at a smaller size: halves are added, that is combined by exclusive or."""
    while x.shape[-1] > size:
        half = x.shape[-1] // 2
        x = x[..., :half] ^ x[..., half:]
    return x


def may_reach(ba: bytes, bb: bytes, na: int, nb: int, percent: int) -> bool:
    """Whether two sets can reach the similarity.

    Tokens in both cancel out, so bitmaps differ in no more bits than sets in tokens.
    """
    size = min(len(ba), len(bb))
    apart = int(np.bitwise_count(_fold(np.frombuffer(ba, np.uint8), size) ^ _fold(np.frombuffer(bb, np.uint8), size)).sum())
    return (100 + percent) * apart <= (100 - percent) * (na + nb)


def order_marks(values: np.ndarray, percent: int) -> bytes:
    """The prefix tokens under each of the further orders, as 16-bit marks; the number of marks of each order comes first."""
    p = prefix_length(len(values), percent)
    h = mix(values, MORE_ORDERS[0])
    marks = []
    # an order by the whole hash and one by its halves exchanged; a mark is of bits that its order does not look at first
    for key, mark in ((h, h), ((h << np.uint64(32)) | (h >> np.uint64(32)), h >> np.uint64(48))):
        first = mark[np.argpartition(key, p - 1)[:p]] if p < len(values) else mark
        marks.append(first.astype(np.uint16))
    return b"".join([np.array([len(m) for m in marks], np.uint32).tobytes(), *(m.tobytes() for m in marks)])


def _marks(packed) -> Iterator[np.ndarray]:
    at = 4 * len(MORE_ORDERS)
    for n in np.frombuffer(packed, np.uint32, len(MORE_ORDERS)).tolist():
        yield np.frombuffer(packed, np.uint16, n, at)
        at += 2 * n


def may_share(oa, ob) -> bool:
    """Whether prefixes may have a token in common under each order; without a mark in common (or a repeated one) they surely have none."""
    for x, y in zip(_marks(oa), _marks(ob)):
        both = np.sort(np.concatenate([x, y]))
        if not (both[1:] == both[:-1]).any():
            return False
    return True


def describe(docs: DataFrame, local_repeats: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(documents, frequent): doc_id, n, class and bitmaps of every document; tokens met in several sets with their counts.

    Both come from one pass over the texts. Each task counts the tokens of its
    different sets and reports those in ``local_repeats`` or more of them; it
    gives the bitmaps of a class once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def frequent() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= local_repeats
            k = int(often.sum())
            return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.array(n[often], pa.int64()), pa.array(tokens[often].view(np.int64)), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()), pa.array(np.ones(k, bool))], names=names)

        for batch in batches:
            sizes, classes, maps, orders = [], [], [], []
            for values in shingle_sets(batch.column("text")):
                name = class_id(values) if len(values) else 0
                sizes.append(len(values))
                classes.append(name)
                maps.append(None)
                orders.append(None)
                if len(values) and name not in seen:
                    seen.add(name)
                    held.append(values)
                    size += len(values)
                    maps[-1], orders[-1] = bitmap(values), order_marks(values, percent)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(maps, pa.binary()), pa.array(orders, pa.binary()), pa.array(np.zeros(len(sizes), bool))], names=names)
            if size > 1_000_000:
                yield frequent()
                held, size = [], 0
        if held:
            yield frequent()
        held.clear()
        release()

    names = ["doc_id", "n", "cls", "bitmap", "orders", "is_token"]
    both = stage(docs.mapInArrow(run, "doc_id long, n long, cls long, bitmap binary, orders binary, is_token boolean"), "join-sets")
    tokens = both.filter("is_token").groupBy(F.col("cls").alias("token")).agg(F.sum("n").alias("n"))
    return both.filter("NOT is_token").select("doc_id", "n", "cls", "bitmap", "orders"), tokens


def _frequent_table(tokens: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted tokens and their levels, of up to ``most`` tokens, the most frequent first.

    Any choice gives right results, since every order serves; more tokens only
    mean fewer candidates.
    """
    counts = stage(tokens.groupBy(F.least(F.col("n"), F.lit(1 << 20)).alias("n")).agg(F.count("*").alias("k")), "join-levels")
    rows = sorted(((r["n"], r["k"]) for r in counts.collect()), reverse=True)
    total, least = 0, None
    for n, k in rows:
        if total + k > most:
            break
        total, least = total + k, n
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    pdf = tokens.filter(F.col("n") >= least).select("token", "n").toArrow()
    values, n = pdf.column("token").to_numpy().view(np.uint64), pdf.column("n").to_numpy()
    order = np.argsort(values)
    return values[order], np.minimum(1 + np.log2(n[order]), 250).astype(np.uint8)


def prefix_tokens(docs: DataFrame, frequent, percent: int) -> DataFrame:
    """(token, cls, n) of the first order; each task gives a class once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            parts, classes, sizes = [], [], []
            held = 0

            def out() -> pa.RecordBatch:
                counts = [len(p) for p in parts]
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64)), pa.array(np.repeat(np.array(classes, np.int64), counts)), pa.array(np.repeat(np.array(sizes, np.int32), counts))], names=["token", "cls", "n"])

            for values in shingle_sets(batch.column("text")):
                if not len(values) or (name := class_id(values)) in seen:
                    continue
                seen.add(name)
                parts.append(prefix(values, _levels(values, frequent.value), 0, percent))
                classes.append(name)
                sizes.append(len(values))
                held += len(parts[-1])
                if held > 200_000:
                    yield out()
                    parts, classes, sizes, held = [], [], [], 0
            if parts:
                yield out()
        release()

    return docs.mapInArrow(run, "token long, cls long, n int")


def _groups(batches: Iterator[pa.RecordBatch], key: str, others: list[str]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Rows sorted by ``key``, a group of two rows at least at a time; a group over many batches is put together once."""
    own, held = None, []  # the key and the pieces of the group that may go on

    def whole() -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*held)] if len(held) > 1 else held[0]

    def many() -> bool:
        return len(held) > 1 or bool(held) and len(held[0][0]) > 1

    for batch in batches:
        keys, *columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in (key, *others)]
        if not len(keys):
            continue
        bounds = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        if held and keys[0] != own:
            if many():
                yield own, whole()
            held = []
        own = int(keys[0])
        held.append([c[:bounds[1]] for c in columns])
        if len(bounds) == 2:
            continue
        if many():
            yield own, whole()
        for a, b in zip(bounds[1:-2], bounds[2:-1]):
            if b - a > 1:  # groups of one row need no look
                yield int(keys[a]), [c[a:b] for c in columns]
        own, held = int(keys[bounds[-2]]), [[c[bounds[-2]:].copy() for c in columns]]
    if many():
        yield own, whole()


def buckets(tokens: DataFrame, parts: int) -> DataFrame:
    """(bucket, cls, n): the classes that share a token, one bucket for each different set of classes in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([b for b, _, _ in held], np.int64), [len(c) for _, c, _ in held])), pa.array(np.concatenate([c for _, c, _ in held])), pa.array(np.concatenate([n for _, _, n in held]))], names=["bucket", "cls", "n"])

        for _, (cls, n) in _groups(batches, "token", ["cls", "n"]):
            cls, first = np.unique(cls, return_index=True)
            if len(cls) < 2:
                continue
            name = class_id(cls.view(np.uint64))
            if name in known:
                continue
            if len(known) >= 1_000_000:
                known.clear()
            known.add(name)
            held.append((name, cls, n[first]))
            size += len(cls)
            if size > 200_000:
                yield out()
                held, size = [], 0
        if held:
            yield out()
        held = []
        known.clear()
        release()

    together = tokens.repartition(parts, "token").sortWithinPartitions("token")
    return together.mapInArrow(run, "bucket long, cls long, n int").groupBy("bucket", "cls").agg(F.min("n").alias("n"))


def _pairs(a: list[int], b: list[int]) -> pa.RecordBatch:
    x, y = np.array(a, np.int64), np.array(b, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def split(members: DataFrame, most: int, turn: int) -> DataFrame:
    """``members`` with buckets of more than ``most`` classes cut up by a hash of the class, another one on each turn.

    What a turn keeps apart may meet on the next one, and in the end all pairs
    of a bucket that are not connected are looked at (``in_blocks``).
    """
    big = _big(members, most)
    if big is None:
        return members
    part = F.xxhash64("bucket", F.pmod(F.xxhash64("cls", F.lit(turn)), F.col("parts")))
    return members.join(big, "bucket", "left").withColumn("bucket", F.when(F.col("parts").isNull(), F.col("bucket")).otherwise(part)).drop("parts")


def in_blocks(members: DataFrame, most: int) -> DataFrame:
    """``members`` with a block each, and with buckets of more than ``most`` classes dealt to all pairs of their blocks."""
    big = _big(members, most)
    if big is None:
        return members.withColumn("block", F.lit(0))
    own = F.coalesce(F.pmod(F.xxhash64("cls"), F.col("parts")), F.lit(0)).cast("int")
    dealt = members.join(big, "bucket", "left").withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), (F.coalesce("parts", F.lit(1)) - 1).cast("int"))))
    pair = F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other"))
    return dealt.withColumn("bucket", F.when(F.col("parts").isNull(), F.col("bucket")).otherwise(pair)).drop("parts", "other")


def _big(members: DataFrame, most: int) -> DataFrame | None:
    """(bucket, parts) of the buckets with more than ``most`` classes."""
    big = stage(members.groupBy("bucket").agg(F.count("*").alias("k")).filter(F.col("k") > most).select("bucket", F.ceil(F.col("k") / most).alias("parts")), "join-big")
    return None if big.isEmpty() else small_side(big, 1_000_000)


def star_pairs(members: DataFrame, percent: int, parts: int, turn: int) -> DataFrame:
    """In each bucket, pairs of a hub with the members that it is not connected with and that fit in size.

    Members have the columns comp and degree (the number of their buckets). On
    the first turn hubs are taken by falling degree until every member has met
    one of its size. On later turns the hub is another class of the bucket's
    largest component each time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []

        def meet(hub: int, others: np.ndarray, cls: np.ndarray) -> None:
            a.extend([int(cls[hub])] * len(others))
            b.extend(cls[others].tolist())

        for _, (cls, n, comp, degree) in _groups(batches, "bucket", ["cls", "n", "comp", "degree"]):
            n = n.astype(np.int64)
            order = np.lexsort((cls, -degree))
            fits = lambda hub, x: x[(100 * np.minimum(n[x], n[hub]) >= percent * np.maximum(n[x], n[hub]))]
            if turn:
                names, sizes = np.unique(comp, return_counts=True)
                inside = order[comp[order] == names[sizes.argmax()]]
                hub = inside[turn % len(inside)]
                meet(hub, fits(hub, np.flatnonzero(comp != comp[hub])), cls)
            else:
                left = order
                while len(left) > 1:
                    hub, met = left[0], fits(left[0], left)
                    meet(hub, met[comp[met] != comp[hub]], cls)
                    left = left[~np.isin(left, met)]
            if len(a) > 100_000:
                yield _pairs(a, b)
                a.clear(), b.clear()
        if a:
            yield _pairs(a, b)

    together = members.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return together.mapInArrow(run, "a long, b long").distinct()


def _reaching(i: int, others: np.ndarray, n: np.ndarray, maps: list[bytes], table: dict[int, np.ndarray], row: np.ndarray, percent: int) -> np.ndarray:
    """Those of ``others`` that can reach the similarity with member ``i``; ``table`` holds their bitmaps by length."""
    own = np.frombuffer(maps[i], np.uint8)
    lengths = np.array([len(maps[j]) for j in others])
    ok = np.zeros(len(others), bool)
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        size = min(int(length), len(own))
        apart = np.bitwise_count(_fold(table[int(length)][row[others[at]]], size) ^ _fold(own, size)).sum(1, dtype=np.int64)
        ok[at] = (100 + percent) * apart <= (100 - percent) * (n[others[at]] + n[i])
    return others[ok]


def cross_pairs(members: DataFrame, percent: int, parts: int) -> DataFrame:
    """All pairs of a bucket (with the columns comp, bitmap and block) that are not connected yet, fit in size and may reach the similarity.

    Where two blocks meet, only pairs across them are looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        held = 0

        def out() -> pa.RecordBatch:
            x, y = np.concatenate(a), np.concatenate(b)
            both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        for _, (cls, n, comp, maps, block) in _groups(batches, "bucket", ["cls", "n", "comp", "bitmap", "block"]):
            order = np.lexsort((cls, n))
            block = block[order]
            across = block.min() != block.max()
            cls, n, comp, maps = cls[order], n[order].astype(np.int64), comp[order], [bytes(maps[j]) for j in order]
            row, table = np.zeros(len(cls), np.int64), {}
            for size in {len(h) for h in maps}:
                at = [j for j, h in enumerate(maps) if len(h) == size]
                row[at] = np.arange(len(at))
                table[size] = np.frombuffer(b"".join(maps[j] for j in at), np.uint8).reshape(len(at), size)
            for i in range(len(cls) - 1):
                to = int(np.searchsorted(n, 100 * n[i] // percent, side="right"))
                others = i + 1 + np.flatnonzero(comp[i + 1:to] != comp[i])
                if across:
                    others = others[block[others] != block[i]]
                for at in range(0, len(others), 4096):
                    found = _reaching(i, others[at:at + 4096], n, maps, table, row, percent)
                    if len(found):
                        a.append(np.full(len(found), cls[i]))
                        b.append(cls[found])
                        held += len(found)
                if held > 500_000:
                    yield out()
                    a, b, held = [], [], 0
        if held:
            yield out()

    together = members.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return together.mapInArrow(run, "a long, b long").distinct()


def _binaries(column: pa.Array) -> Iterator[memoryview]:
    """The values of a binary column without copies."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = memoryview(column.buffers()[2] or b"")
    for at, to in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield data[at:to]


def within_bounds(pairs: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """The pairs whose prefixes may meet under every order and whose bitmaps allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ma, mb, oa, ob = (_binaries(batch.column(c)) for c in ("ma", "mb", "oa", "ob"))
            na, nb = batch.column("na").to_pylist(), batch.column("nb").to_pylist()
            ok = [may_share(o, p) and may_reach(x, y, n, m, percent) for x, y, o, p, n, m in zip(ma, mb, oa, ob, na, nb)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda s: bitmaps.select(F.col("cls").alias(s), F.col("bitmap").alias(f"m{s}"), F.col("orders").alias(f"o{s}"), F.col("n").alias(f"n{s}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    return both.select("a", "b", "ma", "mb", "oa", "ob", "na", "nb").mapInArrow(run, "a long, b long")


def candidate_sets(docs: DataFrame, classes: DataFrame, most_ids: int) -> DataFrame:
    """(cls, tokens) of the classes that stand in a bucket.

    Up to ``most_ids`` of their names are sent to the tasks; beyond that all
    sets are made and joined.
    """
    spark = docs.sparkSession
    names = None
    if classes.count() <= most_ids:
        names = spark.sparkContext.broadcast(np.sort(classes.toArrow().column("cls").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if names is None else names.value
        seen: set[int] = set()
        for batch in batches:
            held: list[np.ndarray] = []
            classes_: list[int] = []
            for values in shingle_sets(batch.column("text")):
                if not len(values) or (name := class_id(values)) in seen:
                    continue
                if wanted is not None:
                    at = np.searchsorted(wanted, name)
                    if at == len(wanted) or wanted[at] != name:
                        continue
                seen.add(name)
                classes_.append(name)
                held.append(values)
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(classes_, pa.int64()), pa.array([v.tobytes() for v in held], pa.binary())], names=["cls", "tokens"])
        release()

    sets = docs.mapInArrow(run, "cls long, tokens binary")
    if names is None:
        sets = sets.join(classes, "cls", "left_semi")
    return sets.groupBy("cls").agg(F.first("tokens").alias("tokens"))


def verify(pairs: DataFrame, sets: DataFrame, percent: int, broadcast_pairs: int = 1_000_000) -> DataFrame:
    """The pairs (u, v) that reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for ta, tb in zip(_binaries(batch.column("ta")), _binaries(batch.column("tb"))):
                x, y = np.frombuffer(ta, np.uint64), np.frombuffer(tb, np.uint64)
                ok.append(similar(x, y, percent))
            yield batch.select(["a", "b"]).rename_columns(["u", "v"]).filter(pa.array(ok, pa.bool_()))
        release()

    # the pairs go to the sets while they are few, and only sets of a pair are then joined
    near = small_side(pairs, broadcast_pairs)
    left = sets.join(near, F.col("cls") == F.col("a")).select("a", "b", F.col("tokens").alias("ta"))
    right = sets.join(near, F.col("cls") == F.col("b")).select("a", "b", F.col("tokens").alias("tb"))
    return left.join(right, ["a", "b"]).select("a", "b", "ta", "tb").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, *, percent: int = 75, local_repeats: int = 2, turns: int = 4, few_pairs: int = 100, most_frequent: int = 2_000_000, most_ids: int = 4_000_000, most_members: int = 1024) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_shingles, component_id.

    Needs ``doc_id`` and ``text``; other columns are ignored. Sets are of
    distinct five-word shingles (A-Z lower-cased); a shorter text is one
    shingle, and a null text or one without words has the empty set, which
    links with nothing. Two documents link when 100 * intersection >=
    ``percent`` * union, so documents with equal sets always link.
    ``component_id`` is the smallest doc_id that links reach. (The number of
    links is not given: pairs that are connected already are not verified.) A
    null doc_id is passed over in that minimum and has
    the component of its text. Repeated rows each give their row. An empty
    table gives an empty result. Shingles and sets go by 64-bit hashes: among
    n different sets, or n different shingles of the sets that are compared,
    two share a name with a chance of about n^2 / 2^65. Buckets of more than
    ``most_members`` classes are compared in parts, by several tasks.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    described, tokens = describe(read, local_repeats, percent)
    frequent = spark.sparkContext.broadcast(_frequent_table(tokens, most_frequent))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    members = stage(buckets(prefix_tokens(read, frequent, percent), parts), "join-buckets")
    rank = members.groupBy("cls").agg(F.count("*").alias("degree"))
    members = stage(members.join(rank, "cls").withColumn("comp", F.col("cls")), "join-members")
    bitmaps = described.filter("bitmap IS NOT NULL").join(members.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(F.first("bitmap").alias("bitmap"), F.first("orders").alias("orders"), F.first("n").alias("n"))
    bitmaps = stage(bitmaps, "join-bitmaps")
    links = roots = tested = None
    turn, last = 0, False
    while True:
        if last:
            made = cross_pairs(in_blocks(members, most_members).join(bitmaps.select("cls", "bitmap"), "cls"), percent, parts).join(tested, ["a", "b"], "left_anti")
        else:
            made = star_pairs(split(members, most_members, turn), percent, parts, turn)
            made = stage(made if tested is None else made.join(tested, ["a", "b"], "left_anti"), "join-pairs")
            tested = made if tested is None else tested.unionByName(made)
        near = stage(within_bounds(made, bitmaps, percent), "join-near")
        sets = stage(candidate_sets(read, near.select(F.col("a").alias("cls")).unionByName(near.select(F.col("b").alias("cls"))).distinct(), most_ids), "join-tokens")
        found = stage(verify(near, sets, percent), "join-links")
        links = found if links is None else stage(links.unionByName(found), "join-links")
        roots = components(links)
        turn += 1
        if last:
            break
        # what is left: buckets whose members are not all connected
        comp = members.select("bucket", "cls", "n", "degree").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("root", "cls")).drop("root")
        comp = stage(comp, "join-members")
        counts = comp.groupBy("bucket", "comp").agg(F.count("*").cast("double").alias("k")).groupBy("bucket").agg(((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).alias("pairs"), F.sum("k").alias("k"))
        apart = stage(counts.filter("pairs > 0"), "join-apart")
        left = apart.agg(F.coalesce(F.sum("pairs"), F.lit(0.0)), F.coalesce(F.sum("k"), F.lit(0.0))).first()
        members = comp.join(apart.select("bucket"), "bucket", "left_semi")
        # more stars only where many pairs are left and the last ones still found links
        last = turn >= turns or left[0] <= few_pairs * left[1] or found.count() * 20 < made.count()
    classes = described.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    classes = classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = stage(classes.join(least, "root").select("cls", "component_id"), "join-classes")
    frequent.unpersist()
    placed = described.join(classes, "cls", "left")
    alone = F.col("n") == 0
    return placed.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, *, broadcast_ids: int = 4_000_000, **options) -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest doc_id, with all columns.

    Rows that share this doc_id stay only once if their texts are equal. Up to
    ``broadcast_ids`` ids to go are sent to the tasks; more are joined by
    shuffling.
    """
    groups = near_duplicates(docs, **options)
    gone = groups.groupBy("doc_id").agg(F.min((~F.col("doc_id").eqNullSafe(F.col("component_id"))).cast("int")).alias("gone"), F.count("*").alias("n"))
    gone = stage(gone.filter("gone = 1 OR n > 1").select(F.col("doc_id").alias("_id"), (F.col("gone") == 1).alias("_gone")), "join-gone")
    kept = docs.join(small_side(gone.filter("_gone"), broadcast_ids), docs["doc_id"].cast("long").eqNullSafe(F.col("_id")), "left_anti")
    if gone.filter("NOT _gone").isEmpty():
        return kept
    single = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return kept.groupBy(kept["doc_id"].alias("_d"), F.sha2(F.coalesce(kept["text"].cast("string"), F.lit("")), 256).alias("_s")).agg(F.first(single).alias("_row")).select("_row.*")
