"""Quality by the perplexity of an interpolated modified Kneser-Ney model of trusted text.

The units are characters (capitals and marks kept), so the model generalises
over words that it never saw; the order is four. Counts of trusted text are
summed over shards of n-grams, and joins between the orders give discounts,
continuation counts, back-off weights and the interpolated probabilities.
Documents whose perplexity lies over a quantile of trusted text in their own
language (and a margin) are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .memory import release
from .staging import small_side, stage

ORDER = 4
BITS, MASK = 16, 0xFFFF
START, UNKNOWN = 1, 0xFFFF


def keys_of(text: str) -> np.ndarray:
    """The 4-gram keys of a text, one for each character: 16 bits a character, the last lowest.

    White space of any length is one blank; characters beyond 16 bits share a
    class; before the first character stand three start marks.
    """
    text = " ".join(text.split())
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    if not len(c):
        return np.zeros(0, np.int64)
    c = np.concatenate([np.full(ORDER - 1, START, np.int64), np.minimum(c, UNKNOWN)])
    n = len(c) - ORDER + 1
    key = np.zeros(n, np.int64)
    for k in range(ORDER):
        key = (key << BITS) | c[k:k + n]
    return key


def count_ngrams(texts: DataFrame) -> DataFrame:
    """(key, n) over the column ``text``; combined in each task first, then summed over shards of keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        size = 0

        def flush():
            key, n = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame({"key": key, "n": n.astype(np.int64)})

        for pdf in batches:
            for text in pdf["text"]:
                if text:
                    k = keys_of(text)
                    held.append(k)
                    size += len(k)
                    if size > 1_500_000:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()
        held = []
        release()

    return texts.select(F.col("text").cast("string").alias("text")).mapInPandas(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _lower(key: str, order: int) -> F.Column:
    """The key without its first character."""
    return F.col(key).bitwiseAND(F.lit((1 << (BITS * (order - 1))) - 1))


def _context(key: str) -> F.Column:
    return F.shiftrightunsigned(key, BITS)


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Discounts for counts of one, two, and three and more, from the numbers of n-grams seen one to four times."""
    seen = {r["n"]: r["k"] for r in counts.filter(F.col("n") <= 4).groupBy("n").agg(F.count("*").alias("k")).collect()}
    n1, n2, n3, n4 = (float(seen.get(i, 0)) for i in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0)
    return tuple(min(max(x, 0.01), i + 0.99) for i, x in enumerate(d))


def train(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(probabilities, backoffs): (n, key, p) of every n-gram seen and (n, key, gamma) of every context.

    ``n`` is the order of the n-gram, and for a context the order that it
    backs off from. Raw counts serve the highest order, the numbers of
    different left neighbours the others; below order one lies an even share
    of all characters and the unknown one.
    """
    counts = {ORDER: stage(count_ngrams(texts), "lm-counts")}
    for n in range(ORDER - 1, 0, -1):
        counts[n] = stage(counts[n + 1].select(_lower("key", n + 1).alias("key")).groupBy("key").agg(F.count("*").alias("n")), f"lm-counts{n}")
    vocabulary = counts[1].count() + 1
    lower: DataFrame | None = None
    probabilities, backoffs = [], []
    for n in range(1, ORDER + 1):
        one, two, more = _discounts(counts[n])
        discount = F.when(F.col("n") == 1, one).when(F.col("n") == 2, two).otherwise(more)
        with_context = counts[n].withColumn("context", _context("key")).withColumn("d", discount)
        contexts = with_context.groupBy("context").agg(F.sum("n").alias("total"), F.sum("d").alias("lost"))
        contexts = contexts.withColumn("gamma", F.col("lost") / F.col("total"))
        p = with_context.join(contexts, "context").withColumn("own", (F.col("n") - F.col("d")) / F.col("total"))
        if lower is None:
            p = p.select("key", (F.col("own") + F.col("gamma") / vocabulary).alias("p"))
        else:
            p = p.withColumn("suffix", _lower("key", n)).join(lower.select(F.col("key").alias("suffix"), F.col("p").alias("p_lower")), "suffix")
            p = p.select("key", (F.col("own") + F.col("gamma") * F.col("p_lower")).alias("p"))
        lower = stage(p, f"lm-p{n}")
        probabilities.append(lower.select(F.lit(n).alias("n"), "key", "p"))
        backoffs.append(contexts.select(F.lit(n).alias("n"), F.col("context").alias("key"), "gamma"))
    unknown = texts.sparkSession.createDataFrame([(0, 0, 1.0 / vocabulary)], "n int, key long, p double")
    out_p, out_b = probabilities[0].unionByName(unknown), backoffs[0]
    for a, b in zip(probabilities[1:], backoffs[1:]):
        out_p, out_b = out_p.unionByName(a), out_b.unionByName(b)
    return stage(out_p, "lm-probabilities"), stage(out_b, "lm-backoffs")


class Scorer:
    """Looks n-grams up in sorted arrays; for models of a checked size."""

    def __init__(self, probabilities: dict[int, tuple[np.ndarray, np.ndarray]], backoffs: dict[int, tuple[np.ndarray, np.ndarray]], floor: float):
        self.p, self.b, self.floor = probabilities, backoffs, floor
        self.cache: tuple[np.ndarray, np.ndarray] | None = None

    @staticmethod
    def _find(table, keys):
        k, v = table
        if not len(k):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(k, keys), len(k) - 1)
        return k[at] == keys, v[at]

    def log_p(self, keys: np.ndarray) -> np.ndarray:
        """Log probability of each 4-gram; unseen ones back off order by order."""
        out, weight = np.empty(len(keys)), np.zeros(len(keys))
        left = np.arange(len(keys))
        for n in range(ORDER, 0, -1):
            k = keys[left] & ((1 << (BITS * n)) - 1) if n < ORDER else keys[left]
            hit, value = self._find(self.p[n], k)
            out[left[hit]] = value[hit] + weight[left[hit]]
            left, k = left[~hit], k[~hit]
            if not len(left):
                return out
            known, gamma = self._find(self.b[n], (k >> BITS) & ((1 << (BITS * (n - 1))) - 1))
            weight[left[known]] += gamma[known]
        out[left] = weight[left] + self.floor
        return out


def _arrays(df: DataFrame, value: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    pdf = df.select("n", "key", F.log(value).cast("float").alias("v")).toArrow().to_pandas()
    out = {}
    for n in range(ORDER + 1):
        part = pdf[pdf["n"] == n].sort_values("key")
        out[n] = (part["key"].to_numpy(np.int64), part["v"].to_numpy(np.float32))
    return out


def score(docs: DataFrame, probabilities: DataFrame, backoffs: DataFrame, *, max_broadcast: int = 8_000_000, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs``, n_units and cost (nats a character; null for a text without any).

    A model of up to ``max_broadcast`` entries (12 bytes each) is sent to the
    workers; beyond that its shards are joined to the documents' n-grams.
    """
    spark = docs.sparkSession
    if probabilities.count() + backoffs.count() > max_broadcast:
        return score_by_joins(docs, probabilities, backoffs, keep=keep)
    floor = float(probabilities.filter("n = 0").select(F.log("p")).first()[0])
    model = spark.sparkContext.broadcast((_arrays(probabilities, "p"), _arrays(backoffs, "gamma"), floor))

    def run(batches):
        scorer = Scorer(*model.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            units, costs = [], []
            for at in range(0, len(texts), 128):
                keys = [keys_of(t) if t else np.zeros(0, np.int64) for t in texts[at:at + 128]]
                sizes = np.array([len(k) for k in keys])
                every = np.concatenate(keys)
                if len(every):
                    unique, back = np.unique(every, return_inverse=True)
                    value = scorer.log_p(unique)[back]
                    ends = np.cumsum(sizes)
                    sums = np.concatenate([[0.0], np.cumsum(value)])
                    total = sums[ends] - sums[ends - sizes]
                else:
                    total = np.zeros(len(keys))
                units += sizes.tolist()
                costs += [-float(t) / int(s) if s else None for t, s in zip(total, sizes)]
            arrays = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(units, pa.int64()), pa.array(costs, pa.float64())], names=[*keep, "n_units", "cost"])
        release()

    read = docs.select(*[F.col(c) for c in keep], F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes) + ", n_units long, cost double"
    return read.mapInArrow(run, schema)


def score_by_joins(docs: DataFrame, probabilities: DataFrame, backoffs: DataFrame, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """As ``score``, for a model of any size: every shard of the model is joined to the n-grams that ask for it."""
    numbered = stage(docs.select(F.monotonically_increasing_id().alias("_row"), *keep, F.col("text").cast("string").alias("_text")), "lm-docs")

    def run(batches):
        for pdf in batches:
            for row, text in zip(pdf["_row"], pdf["_text"]):
                if text:
                    key, n = np.unique(keys_of(text), return_counts=True)
                    yield pd.DataFrame({"_row": row, "key": key, "times": n.astype(np.int64)})

    asked = numbered.select("_row", "_text").mapInPandas(run, "_row long, key long, times long")
    floor = float(probabilities.filter("n = 0").select(F.log("p")).first()[0])
    open_ = asked.withColumn("w", F.lit(0.0)).withColumn("v", F.lit(None).cast("double"))
    for n in range(ORDER, 0, -1):
        k = F.col("key") if n == ORDER else F.col("key").bitwiseAND(F.lit((1 << (BITS * n)) - 1))
        p = probabilities.filter(F.col("n") == n).select(F.col("key").alias("pk"), F.log("p").alias("lp"))
        b = backoffs.filter(F.col("n") == n).select(F.col("key").alias("bk"), F.log("gamma").alias("lg"))
        open_ = open_.withColumn("k", k).join(p, F.col("k") == F.col("pk"), "left")
        context = F.shiftrightunsigned("k", BITS)
        open_ = open_.withColumn("c", context).join(b, F.col("c") == F.col("bk"), "left")
        value = F.coalesce("v", F.col("lp") + F.col("w"))
        open_ = open_.select("_row", "key", "times", value.alias("v"), (F.col("w") + F.coalesce("lg", F.lit(0.0))).alias("w"))
    sums = open_.groupBy("_row").agg(F.sum("times").alias("n_units"), F.sum(F.col("times") * F.coalesce("v", F.col("w") + floor)).alias("total"))
    return numbered.join(sums, "_row", "left").select(*keep, F.coalesce("n_units", F.lit(0)).cast("long").alias("n_units"), (-F.col("total") / F.col("n_units")).alias("cost"))


def limits(scored: DataFrame, quantile: float, margin: float, least: int) -> DataFrame:
    """(lang, limit) in nats: the quantile of held-out trusted documents, exact to a thousandth, plus the margin.

    Languages with fewer than ``least`` of them use those of all languages.
    """
    seen = scored.filter("held_out AND cost IS NOT NULL").groupBy("lang", F.round("cost", 3).alias("cost")).agg(F.count("*").alias("n"))
    seen = stage(seen, "lm-histogram")
    every = seen.groupBy("cost").agg(F.sum("n").alias("n")).withColumn("lang", F.lit(None).cast("string")).withColumn("whole", F.lit(True))
    both = seen.withColumn("whole", F.lit(False)).unionByName(every)
    w = Window.partitionBy("whole", "lang")
    both = both.withColumn("upto", F.sum("n").over(w.orderBy("cost"))).withColumn("all", F.sum("n").over(w))
    cut = both.filter(F.col("upto") >= F.col("all") * quantile).groupBy("whole", "lang").agg((F.min("cost") + margin).alias("limit"), F.first("all").alias("all"))
    return cut.filter((F.col("all") >= least) | F.col("whole"))


def judge(docs: DataFrame, labels: DataFrame, *, quantile: float = 0.995, margin: float = 0.05, least: int = 20, folds: int = 5, broadcast_ids: int = 4_000_000, **options) -> DataFrame:
    """A row per row of ``docs``: doc_id, lang, n_units, perplexity, limit, keep.

    ``docs`` needs doc_id, text and lang (others are ignored), ``labels``
    doc_id, quality and toxic. Trusted are documents with quality 1 and not
    toxic in some label and with no label that says otherwise; nulls are no
    evidence either way. One of ``folds`` parts of them, by a hash of the id,
    sets the limits and the others train the model, so that the limits hold
    for texts that the model has not seen. Up to ``broadcast_ids`` trusted ids
    are sent to the tasks; more are joined by shuffling. A null or blank text has no perplexity and is
    rejected. A null language is one of its own. Without trusted text
    everything with text is kept. Repeated rows each give their row. Tables
    may be empty.
    """
    bad = F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))
    good = F.coalesce((F.col("quality") == 1) & F.coalesce(F.col("toxic") == 0, F.lit(True)), F.lit(False))
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_label_id")).agg(F.max(bad).alias("_bad"), F.max(good).alias("_good"))
    held_out = F.pmod(F.xxhash64("_label_id"), F.lit(folds)) == 0
    marks = stage(marks.filter("_good AND NOT _bad").select("_label_id", held_out.alias("held_out")), "lm-trusted")
    read = docs.select("doc_id", "lang", "text")
    trusted = read.join(small_side(marks.filter("NOT held_out").select("_label_id"), broadcast_ids), F.col("doc_id").cast("long") == F.col("_label_id"), "left_semi")
    probabilities, backoffs = train(trusted.select("text"))
    scored = stage(score(read.select("doc_id", "lang", "text"), probabilities, backoffs, keep=("doc_id", "lang"), **options), "lm-scored")
    flagged = scored.join(marks.filter("held_out"), F.col("doc_id").cast("long") == F.col("_label_id"))
    cuts = limits(flagged, quantile, margin, least)
    # languages are few: one row each, checked by the planner before it is sent around
    own = cuts.filter(~F.col("whole")).select(F.col("lang").alias("_lang"), F.col("limit").alias("_own"))
    overall = cuts.filter("whole").select(F.col("limit").alias("_all"))
    whole = overall.first()
    out = scored.join(own, scored["lang"].eqNullSafe(F.col("_lang")), "left").withColumn("limit", F.coalesce("_own", F.lit(whole[0] if whole else None).cast("double")))
    keep = F.col("cost").isNotNull() & F.coalesce(F.col("cost") <= F.col("limit"), F.lit(True))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "n_units", F.exp("cost").alias("perplexity"), F.exp("limit").alias("limit"), keep.alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, *, broadcast_ids: int = 4_000_000, **options) -> DataFrame:
    """``docs`` without the documents that ``judge`` rejects, with all columns.

    A doc_id that stands for several rows goes only if all of them are rejected.
    """
    verdicts = stage(judge(docs, labels, broadcast_ids=broadcast_ids, **options).groupBy("doc_id").agg(F.max("keep").alias("keep")).filter("NOT keep").select(F.col("doc_id").alias("_gone")), "lm-gone")
    return docs.join(small_side(verdicts, broadcast_ids), docs["doc_id"].cast("long").eqNullSafe(F.col("_gone")), "left_anti")
