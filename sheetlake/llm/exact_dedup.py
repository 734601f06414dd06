"""Exact duplicates by an extendible-hash index kept in shared files (DataFrame functions only).

Keys are 64-bit hashes of the normalised text. The directory doubles where
buckets are overfull: a bucket is a range of keys that agree in their first
``local_depth`` bits, the fewest with which it holds no more than ``capacity``
different keys. Rows find their bucket through the directory and go to the
task that owns its range; this task alone sees the bucket's entries. Where
documents meet in a key their bytes are compared, and different texts of one
key are chained in the bucket, each with an entry of its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import small_side, stage

#: A key is frequent with more than one in so many rows, so there are no more frequent keys than this.
FREQUENT_SHARE, SALTS = 2000, 32
#: A directory of so many buckets is sent to the tasks; a larger one is joined by shuffling.
DIRECTORY_ROWS = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only.

    ``lower`` is the fast way and does just that unless the text has another
    capital (or a character that the regex engine does not know yet).
    """
    return F.when(c.rlike(r"[\p{IsUppercase}\p{Lt}\p{Cn}&&[^A-Z]]"), F.translate(c, UPPER, LOWER)).otherwise(F.lower(c))


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text.cast("string"), F.lit("")))


def _start(h: Column, depth: int) -> Column:
    """The first key of the range of keys that agree with ``h`` in ``depth`` bits; it names the bucket."""
    mask = (-1 << (64 - depth)) if depth else 0
    return h.bitwiseAND(F.lit(mask).cast("long"))


def directory(entries: DataFrame, capacity: int, *, more_bits: int = 3) -> DataFrame:
    """(local_depth, bucket) of all buckets with a key; ``entries`` has the different keys ``h``.

    Depth grows until each bucket fits. Keys are counted at about the depth
    that evenly spread ones need, sums over fewer bits follow from that, and
    only what is overfull still is counted at further depths. Rows are about
    ``2**more_bits`` times keys / capacity.
    """
    wide, found = entries.select("h"), None
    n = wide.count()
    low, high = 0, min(64, max(0, math.ceil(math.log2(max(n, 1) / capacity))) + more_bits)
    while True:
        cells = wide.groupBy(_start(F.col("h"), high).alias("cell")).agg(F.count("*").alias("n"))
        ranges = F.array(*[F.struct(F.lit(d).alias("local_depth"), _start(F.col("cell"), d).alias("bucket")) for d in range(low, high + 1)])
        sums = stage(cells.select("cell", "n", F.explode(ranges).alias("r")).groupBy("r").agg(F.sum("n").alias("held"), F.collect_list("cell").alias("cells")).select("r.*", "held", "cells"), "dedup-cells")
        fits = sums.filter(F.col("held") <= capacity).select(F.explode("cells").alias("cell"), F.struct("local_depth", "bucket").alias("r"))
        fits = fits.groupBy("cell").agg(F.min("r").alias("r")).select("r.*").distinct()
        found = fits if found is None else found.unionByName(fits)
        over = sums.filter((F.col("local_depth") == high) & (F.col("held") > capacity)).select(F.col("bucket").alias("cell"))
        if high == 64 or over.isEmpty():
            return stage(found, "dedup-directory")
        wide = wide.withColumn("cell", _start(F.col("h"), high)).join(small_side(over, DIRECTORY_ROWS), "cell", "left_semi").select("h")
        low, high = high + 1, min(64, high + 8)


def located(keys: DataFrame, buckets: DataFrame) -> DataFrame:
    """``keys`` with the bucket that the directory gives for ``h``; keys outside of all buckets are left out."""
    depths = sorted(r[0] for r in buckets.select("local_depth").distinct().collect()) or [0]  # 65 at most
    tries = F.array(*[F.struct(F.lit(d).alias("local_depth"), _start(F.col("h"), d).alias("bucket")) for d in depths])
    if len(depths) == 1:
        tried = keys.withColumn("local_depth", F.lit(depths[0])).withColumn("bucket", _start(F.col("h"), depths[0]))
    else:
        tried = keys.withColumn("_try", F.explode(tries)).select(*keys.columns, "_try.*")
    return tried.join(small_side(buckets, DIRECTORY_ROWS), ["local_depth", "bucket"], "left_semi")


def frequent_keys(counts: DataFrame, share: int = FREQUENT_SHARE) -> DataFrame:
    """(h) of the keys with more than one in ``share`` of all rows, so never more than ``share`` of them; ``counts`` has h and n."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.filter(F.col("n") > max(1, total // share)).select("h")


def _keys(docs: DataFrame, key_bits: int) -> DataFrame:
    """(doc_id, h, sha) of each row. ``key_bits`` shortens the keys, for tests of the chaining."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("norm"))
    return read.select("doc_id", _key(key_bits).alias("h"), F.unhex(F.sha2("norm", 256)).alias("sha"))


def _key(key_bits: int) -> Column:
    return F.shiftleft(F.shiftrightunsigned(F.xxhash64("norm"), 64 - key_bits), 64 - key_bits)


def _apart(docs: DataFrame, keys: DataFrame, met: DataFrame, key_bits: int, broadcast_rows: int) -> DataFrame:
    """(h) of the keys under which different texts meet, by their bytes.

    Only texts of keys with more than one row are read closely. Those of a
    frequent key are dealt over salts, and one text of each salt is compared
    further.
    """
    again = stage(met.filter("n > 1").select("h", "n"), "dedup-again")
    frequent = stage(frequent_keys(met), "dedup-frequent")
    shared = small_side(again.select("h"), broadcast_rows)
    ids = stage(keys.join(shared, "h", "left_semi").select(F.col("doc_id").alias("_id")).distinct(), "dedup-ids")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    if ids.limit(broadcast_rows + 1).count() <= broadcast_rows:  # spares the rest the hashing
        read = read.join(F.broadcast(ids), F.expr("doc_id <=> _id"), "left_semi")
    texts = read.select("doc_id", normalised(F.col("text")).alias("norm")).select("doc_id", "norm", _key(key_bits).alias("h")).join(shared, "h", "left_semi")
    texts = texts.join(F.broadcast(frequent.withColumn("often", F.lit(True))), "h", "left")
    salt = F.when(F.col("often").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).cast("int")
    ends = texts.select("h", salt.alias("salt"), "norm").groupBy("h", "salt").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi"))
    equal = F.col("lo") == F.col("hi")
    sample = F.when(equal & (F.col("salt") > 0), F.col("lo"))
    compared = ends.select("h", equal.alias("equal"), sample.alias("norm")).groupBy("h").agg((F.min("equal") & F.coalesce(F.min("norm") == F.max("norm"), F.lit(True))).alias("same"))
    return stage(compared.filter(~F.col("same")).select("h"), "dedup-apart")


def build_index(docs: DataFrame, *, capacity: int = 65536, key_bits: int = 64, broadcast_rows: int = 4_000_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(keys, buckets, index): a row per document, the directory, and an entry per different text.

    The index has bucket, local_depth, h, sha, keep_id and group_size; its
    files hold ranges of buckets, in order, so that a reader of a bucket skips
    the others.
    """
    keys = stage(_keys(docs, key_bits), "dedup-keys")
    # rows of one key are added up before anything is dealt by key
    met = stage(keys.groupBy("h").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep_id"), F.min("sha").alias("sha")), "dedup-met")
    apart = _apart(docs, keys, met, key_bits, broadcast_rows)
    entries = met.select("h", "sha", "keep_id", "n")
    if not apart.isEmpty():
        read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("norm")).select("doc_id", "norm", _key(key_bits).alias("h"))
        chained = read.join(small_side(apart, broadcast_rows), "h", "left_semi").groupBy("h", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
        entries = entries.join(small_side(apart, broadcast_rows), "h", "left_anti").unionByName(chained.select("h", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "n"))
    buckets = directory(met, capacity)
    owned = located(entries.withColumnRenamed("n", "group_size"), buckets).repartitionByRange("bucket").sortWithinPartitions("bucket", "h", "sha")
    return keys, buckets, stage(owned.select("bucket", "local_depth", "h", "sha", "keep_id", "group_size"), "dedup-index")


def lookup(keys: DataFrame, buckets: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, sha, keep_id, group_size) for the rows of ``keys`` that have an entry.

    Rows go to the owner of their bucket, which reads this bucket only.
    Entries of frequent texts are few, by their share, and go to the rows
    instead.
    """
    often = stage(frequent_keys(index.select(F.struct("bucket", "h", "sha").alias("h"), F.col("group_size").alias("n"))).select("h.*"), "dedup-often")
    large = F.broadcast(index.join(F.broadcast(often), ["bucket", "h", "sha"], "left_semi"))
    at = located(keys, buckets).select("doc_id", "bucket", "h", "sha")
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = at.join(F.broadcast(often), ["bucket", "h", "sha"], "left_anti").repartition(parts, "bucket")
    found = rest.join(index.repartition(parts, "bucket"), ["bucket", "h", "sha"])
    return found.unionByName(at.join(large, ["bucket", "h", "sha"]).select(*found.columns)).select("doc_id", "sha", "keep_id", "group_size")


def exact_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Needs the columns ``doc_id`` and ``text``; others are ignored, whatever
    their names. A null text counts as empty. Texts are equal when identical
    after lower-casing A-Z only; the row with the largest doc_id stays. Rows
    that repeat both doc_id and text all say ``kept`` (they are the same row;
    ``drop_exact_duplicates`` leaves one of them). A null doc_id is smaller
    than any other. An empty table gives an empty result.
    """
    return lookup(*build_index(docs, **options)).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def seen_before(docs: DataFrame, buckets: DataFrame, index: DataFrame, *, key_bits: int = 64) -> DataFrame:
    """(doc_id, keep_id, text_sha256) for the rows of other documents whose text has an entry in a built index."""
    found = lookup(stage(_keys(docs, key_bits), "dedup-asked"), buckets, index)
    return found.select("doc_id", "keep_id", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, *, broadcast_rows: int = 4_000_000, **options) -> DataFrame:
    """``docs`` with one row of each group of equal texts, with all its columns.

    Up to ``broadcast_rows`` names of rows to go are sent to the tasks; more
    are joined by shuffling. Texts are hashed again only for ids of several
    rows.
    """
    flags = stage(exact_duplicates(docs, broadcast_rows=broadcast_rows, **options), "dedup-flags")
    repeated = stage(flags.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("_id")), "dedup-repeated")
    own = docs["doc_id"].cast("long")
    gone = stage(flags.filter("NOT kept").select(F.col("doc_id").alias("_gone_id"), F.unhex("text_sha256").alias("_gone_sha")).distinct(), "dedup-gone")
    out = docs.join(small_side(gone.select("_gone_id"), broadcast_rows), own.eqNullSafe(F.col("_gone_id")), "left_anti")
    if repeated.isEmpty():
        return out
    out = out.join(small_side(repeated, broadcast_rows), own.eqNullSafe(F.col("_id")), "left_anti")
    odd = docs.join(small_side(repeated, broadcast_rows), own.eqNullSafe(F.col("_id")), "left_semi")
    sha = F.sha2(normalised(docs["text"]), 256)
    odd = odd.join(small_side(gone, broadcast_rows), own.eqNullSafe(F.col("_gone_id")) & (F.unhex(sha) == F.col("_gone_sha")), "left_anti")
    # the same row more than once: any of them is as good as another
    single = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return out.unionByName(odd.groupBy(own.alias("_d"), sha.alias("_s")).agg(F.first(single).alias("_row")).select("_row.*"))
