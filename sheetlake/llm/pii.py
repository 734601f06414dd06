"""Personal data: patterns, then information-theoretic sanitisation (DataFrame functions only).

Patterns find the protected entities: e-mail addresses, IP addresses, card and
phone numbers. Corpus co-occurrence then tells how strongly a term reveals an
entity: with N documents, ``PMI(t, e) = log2(n_te * N / (n_t * n_e))`` against
the information content ``IC(e) = log2(N / n_e)``. PMI reaches IC exactly when
the term never occurs without the entity. Terms with ``PMI >= remove_at * IC``
for any entity are removed and those with ``PMI >= generalise_at * IC`` replaced
by their class, in every document: where the entity is not written, the term
discloses it by itself.

An entity is a value, a class of values that can recur (e-mail domain, network
of an address, issuer of a card, area of a phone number) or a whole kind. All
counts are of different texts, so that copies of one text prove nothing, and
of words outside the patterns' places. Small counts are tested, not discarded:
a pair counts if chance would bring a term of the corpus and an entity together
that often in any pair at all with a probability of ``chance`` at most
(Chernoff's bound of the binomial tail, times entities times terms).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import small_side, stage

#: Kinds in the order in which spans at the same place are listed.
KINDS = ("email", "ip", "card", "phone", "term")
#: Possessive forms match the same spans as the plain patterns and never backtrack; the look-behind
#: starts a try only at the start of a run (or where the last match ended), so long runs stay linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
TERM = r"[\p{L}\p{N}]++"
#: Stands for a pattern's place while words are cut; a private character, and a blank where a text holds it.
PLACE = "\ue000"
TERM_OR_PLACE = rf"[\p{{L}}\p{{N}}{PLACE}]++"
SPAN = "array<struct<start:int,kind:int,end:int>>"
FOUND = "array<struct<start:int,kind:int,end:int,value:string>>"
TERMS = "array<struct<start:int,kind:int,end:int,action:string>>"
#: Arrays are worked through in blocks of so many, so that no array grows by one element over and over.
BLOCK = 128


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    d = _digits(x)
    n = F.length(d)

    def value(i: Column) -> Column:
        one = F.ascii(F.substring(d, n - i, F.lit(1))) - 48
        return F.when(i % 2 == 0, one).when(one > 4, one * 2 - 9).otherwise(one * 2)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    n = F.length(_digits(x))
    if kind == "ip":
        def part(p: Column) -> Column:
            short = F.regexp_replace(p, "^0+(?=[0-9])", "")
            return (F.length(short) <= 3) & F.coalesce(short.try_cast("int") <= 255, F.lit(False))
        return F.forall(F.split(x, r"\."), part)
    if kind == "card":
        return n.between(14, 19) & _luhn(x)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` made once, however often it is used; in a lambda it would be made for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _blocks(parts: Column) -> Column:
    last = F.floor((F.size(parts) - 1) / BLOCK).cast("int")
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda b: F.slice(parts, b * BLOCK + 1, F.lit(BLOCK))))


def _befores(totals: Column, add) -> Column:
    """For each of ``totals``, what all before it come to."""
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(totals, first, lambda acc, t: F.struct(add(acc["at"], t).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


def _placed(parts: Column, schema: str, item) -> Column:
    """What ``item`` makes of the ``parts`` that are ok, in order; parts have gap, len and ok and follow each other. Null if there are none."""
    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["len"]
        return F.struct(end.alias("at"), F.when(x["ok"], F.concat(acc["out"], F.array(item(x, start, end)).cast(schema))).otherwise(acc["out"]).alias("out"))

    def of_block(block: Column, before: Column) -> Column:
        return F.aggregate(block, F.struct(before.alias("at"), F.array().cast(schema).alias("out")), step, lambda acc: acc["out"])

    def held(p: Column) -> Column:
        return F.transform(_blocks(p), lambda b: F.struct(b.alias("block"), F.aggregate(b, F.lit(0), lambda a, x: a + x["gap"] + x["len"]).alias("total")))

    return _once(parts, lambda p: _once(held(p), lambda h: F.flatten(F.zip_with(h, _befores(h["total"], lambda a, t: a + t), lambda x, at: of_block(x["block"], at)))))


def pattern_spans(text: Column, kind: str) -> Column:
    """Sorted array of (start, kind, end, value) in code points; leftmost non-overlapping, failing matches dropped."""
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    parts = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(found)), found,
        lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("len"), _valid(kind, m).alias("ok"), m.alias("value")),
    )

    spans = _placed(parts, FOUND, lambda x, start, end: F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), x["value"].alias("value")))
    hint = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(HINTS[kind])
    return F.coalesce(F.when(hint, spans), F.array().cast(FOUND))


def written(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def classes_of(kind: str, x: Column) -> Column:
    """The entities a value stands for: itself, the classes it belongs to, its kind."""
    d = _digits(x)
    own = {
        "email": [x, F.regexp_replace(x, "^.*@", "@")],
        "ip": [x, F.regexp_replace(x, r"[0-9]+$", "*"), F.regexp_replace(x, r"[0-9]+\.[0-9]+$", "*")],
        "card": [d, F.concat(F.substring(d, 1, 6), F.lit("*"))],
        "phone": [d, F.concat(F.substring(d, 1, 4), F.lit("*"))],
    }[kind]
    return F.array(*[F.concat(F.lit(f"{kind}:"), v) for v in own], F.lit(kind))


def find_entities(docs: DataFrame) -> DataFrame:
    """A row per document, staged: row, doc_id, h, spans by pattern, entities, text."""
    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    read = read.select("row", "doc_id", "text", *[pattern_spans(F.col("text"), k).alias(k) for k in KINDS[:4]])
    spans = F.array_sort(F.concat(*KINDS[:4]))

    def entities(s: Column) -> Column:
        value = F.lower(s["value"])
        found = classes_of(KINDS[3], value)
        for k in range(3):
            found = F.when(s["kind"] == k, classes_of(KINDS[k], value)).otherwise(found)
        return found

    read = read.withColumn("spans", spans).withColumn("entities", F.array_distinct(F.flatten(F.transform("spans", entities)))).withColumn("spans", F.transform("spans", lambda s: s.dropFields("value")))
    return stage(read.select("row", "doc_id", F.xxhash64("text").alias("h"), "spans", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:4]], "entities", "text"), "pii-found")


def terms_of(min_length: int) -> Column:
    """The different words of ``text`` of that length at least that no pattern's place touches."""
    text, spans = F.col("text"), F.col("spans")
    marks = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(PLACE).alias("label")))
    marked = F.regexp_extract_all(_cleaned(F.translate(text, PLACE, " "), marks), F.lit(TERM_OR_PLACE), F.lit(0))
    words = F.when(F.size(spans) > 0, F.filter(marked, lambda w: ~F.contains(w, F.lit(PLACE)))).otherwise(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))
    return F.array_distinct(F.filter(F.transform(words, F.lower), lambda w: F.length(w) >= min_length))


def revealing_terms(found: DataFrame, chance: float, remove_at: float, generalise_at: float, min_length: int, broadcast_rows: int, broadcast_bytes: int) -> DataFrame | None:
    """(term, action) for terms over a disclosure threshold; None if no entity occurs often enough for the test."""
    firsts = stage(found.groupBy("h").agg(F.min("row").alias("first"), F.count("*").alias("n")), "pii-texts")
    total = firsts.count()
    repeated = small_side(firsts.filter("n > 1").select("h", "first"), broadcast_rows)
    texts = found.join(repeated, "h", "left").filter("first IS NULL OR first = row")
    # entities of the same texts say the same of every term, so they are one
    held = texts.select("row", F.explode("entities").alias("entity"))
    known = stage(held.groupBy("entity").agg(F.count("*").alias("n_e"), F.bit_xor(F.xxhash64("row")).alias("x"), F.sum(F.xxhash64(F.lit(1), "row").cast("decimal(38,0)")).alias("y")), "pii-entities")
    entities = known.count()
    if not entities:
        return None
    often = stage(texts.select(F.explode(terms_of(min_length)).alias("term")).groupBy("term").agg(F.count("*").alias("n_t")), "pii-often")
    needed = math.log(max(entities * often.count(), 1) / chance)
    # no term has more evidence than one that is always and only with the entity
    able = stage(known.filter(F.col("n_e") * F.log(F.lit(float(total)) / F.col("n_e")) >= needed).select("entity", "n_e", F.xxhash64("n_e", "x", "y").alias("group")), "pii-able")
    if able.isEmpty():
        return None
    # nor can a term be over a threshold that is in too few texts for the test, or in too many for any entity
    most = able.agg(F.max(F.col("n_e") * F.pow(F.lit(float(total)) / F.col("n_e"), F.lit(1 - min(remove_at, generalise_at))))).first()[0]
    fit = (F.col("n_t") * F.log(F.lit(float(total)) / F.least(F.col("n_t"), F.lit(total / math.e))) >= needed) & (F.col("n_t") <= F.lit(most * (1 + 1e-9)))
    fit = small_side(stage(often.filter(fit), "pii-fit"), broadcast_rows, broadcast_bytes)
    grouped = held.join(small_side(able.select("entity", "group"), broadcast_rows, broadcast_bytes), "entity").select("row", "group").distinct()
    words = texts.filter(F.size("entities") > 0).select("row", F.explode(terms_of(min_length)).alias("term")).join(fit.select("term"), "term", "left_semi")
    pairs = words.join(grouped, "row").groupBy("group", "term").agg(F.count("*").alias("n_te"))
    scored = pairs.join(fit, "term").join(small_side(able.select("group", "n_e").distinct(), broadcast_rows), "group")
    rate, base = F.col("n_te") / F.col("n_e"), F.col("n_t") / F.lit(float(total))
    rest = F.when(F.col("n_te") < F.col("n_e"), (1 - rate) * F.log((1 - rate) / (1 - base))).otherwise(0.0)
    tested = (rate > base) & (F.col("n_e") * (rate * F.log(rate / base) + rest) >= needed)
    pmi, ic = F.log2(rate / base), F.log2(F.lit(float(total)) / F.col("n_e"))
    scored = scored.filter(tested).withColumn("share", F.when(ic > 0, pmi / ic))
    action = F.when(F.col("share") >= remove_at, "remove").when(F.col("share") >= generalise_at, "generalise")
    return stage(scored.select("term", action.alias("action")).filter("action is not null"), "pii-terms")


def term_spans(found: DataFrame, terms: DataFrame, broadcast_rows: int, broadcast_bytes: int) -> DataFrame:
    """``found`` with ``terms``, the places of revealing terms, in all documents."""
    flagged = terms.groupBy("term").agg(F.max("action").alias("action"))  # "remove" sorts after "generalise"
    words = F.regexp_extract_all("text", F.lit(TERM), F.lit(0))
    held = found.select("row", F.explode(F.array_distinct(F.transform(words, F.lower))).alias("term")).join(small_side(stage(flagged, "pii-flagged"), broadcast_rows, broadcast_bytes), "term")
    # each document's own flagged words, and then their places in it
    held = stage(held.groupBy("row").agg(F.collect_list(F.struct("term", "action")).alias("held")), "pii-held")
    # beyond the bound a hash table for each partition, so that no text is sorted
    out = found.join(small_side(held.hint("shuffle_hash"), broadcast_rows, broadcast_bytes), "row", "left")

    def part(gap: Column, word: Column) -> Column:
        action = F.get(F.filter(F.col("held"), lambda t: t["term"] == F.lower(word)), F.lit(0))["action"]
        return F.struct(F.length(gap).alias("gap"), F.length(word).alias("len"), action.alias("action"), action.isNotNull().alias("ok"))

    parts = F.zip_with(F.slice(F.split("text", TERM, -1), F.lit(1), F.size(words)), words, part)
    placed = _placed(parts, TERMS, lambda x, start, end: F.struct(start.alias("start"), F.lit(4).alias("kind"), end.alias("end"), x["action"].alias("action")))
    return out.withColumn("terms", F.coalesce(F.when(F.col("held").isNotNull(), placed), F.array().cast(TERMS))).drop("held")


def _cleaned(text: Column, marks: Column) -> Column:
    """The text with each marked place replaced; of marks (sorted by start) that overlap the first one's label stands.

    The text is cut at blocks of marks first, so that no mark needs a walk
    through all of it.
    """
    def held(m: Column) -> Column:
        return F.transform(_blocks(m), lambda b: F.struct(b.alias("block"), F.aggregate(b, F.lit(0), lambda a, m: F.greatest(a, m["end"])).alias("total")))

    def placed(h: Column) -> Column:
        return F.zip_with(h, _befores(h["total"], lambda a, t: F.greatest(a, t)), lambda x, at: F.struct(x["block"].alias("block"), at.alias("at"), F.greatest(x["total"], at).alias("to"), F.substring(text, at + 1, F.greatest(x["total"] - at, F.lit(0))).alias("text")))

    def step(acc: Column, m: Column, x: Column) -> Column:
        apart = m["start"] >= acc["at"]
        gap = F.substring(x["text"], acc["at"] - x["at"] + 1, m["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], m["end"]).alias("at"), F.when(apart, F.concat(acc["out"], gap, m["label"])).otherwise(acc["out"]).alias("out"))

    def joined(x: Column) -> Column:
        return F.aggregate(x["block"], F.struct(x["at"].alias("at"), F.lit("").alias("out")), lambda acc, m: step(acc, m, x), lambda acc: acc["out"])

    def done(p: Column) -> Column:
        return F.concat(F.array_join(F.transform(p, joined), ""), F.substring(text, F.element_at(p, -1)["to"] + 1, F.length(text)))

    kind = "array<struct<start:int,end:int,label:string>>"
    cleaned = _once(marks.cast(kind), lambda m: _once(held(m), lambda h: _once(placed(h), done)))
    return F.when(F.size(marks) > 0, cleaned).otherwise(text)


def sanitise(docs: DataFrame, *, chance: float = 0.05, remove_at: float = 0.95, generalise_at: float = 0.85, min_length: int = 3, broadcast_rows: int = 1_000_000, broadcast_bytes: int = 64 << 20, with_text: bool = True) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term, n_removed[, clean_text].

    Needs ``doc_id`` and ``text``; other columns are ignored, whatever their
    names. A null text counts as empty: no spans, the hash of the empty
    string. Repeated rows each give their row. Words of the term search are
    runs of letters and digits in lower case, of ``min_length`` at least;
    places that overlap a pattern's are left to it. In ``clean_text`` patterns
    become ``[EMAIL]`` and the like, generalised terms ``[WORD]``,
    ``[NAME]`` (capitalised) or ``[NUMBER]``, and removed terms vanish. An
    empty table gives an empty result. Tables of terms, entities and the
    documents' flagged words go to all tasks up to ``broadcast_rows`` rows
    and ``broadcast_bytes`` bytes each, and are joined by shuffling beyond.
    """
    found = find_entities(docs)
    terms = revealing_terms(found, chance, remove_at, generalise_at, min_length, broadcast_rows, broadcast_bytes)
    if terms is None or terms.isEmpty():
        out = found.withColumn("terms", F.array().cast(TERMS))
    else:
        out = term_spans(found, terms, broadcast_rows, broadcast_bytes)
    apart = F.filter("terms", lambda t: ~F.exists("spans", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    out = out.withColumn("terms", apart)
    extra = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["kind"].alias("kind"), t["end"].alias("end"))).cast(SPAN)
    columns = [
        "doc_id", *[f"n_{k}" for k in KINDS[:4]],
        F.sha2(written(F.col("spans")), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("spans", extra))).alias("spans"),
        F.size("terms").cast("long").alias("n_term"),
        F.size(F.filter("terms", lambda t: t["action"] == "remove")).cast("long").alias("n_removed"),
    ]
    if with_text:
        text = F.col("text")
        names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
        base = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(names, s["kind"]).alias("label")))
        def label(t: Column) -> Column:
            word = F.substring(text, t["start"] + 1, t["end"] - t["start"])
            kind = F.when(word.rlike(r"^\p{N}"), "[NUMBER]").when(word.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
            return F.when(t["action"] == "remove", "").otherwise(kind)
        more = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), label(t).alias("label")))
        out = out.withColumn("marks", F.array_sort(F.concat(base, more))).withColumn("clean_text", _cleaned(text, F.col("marks")))
        columns.append("clean_text")
    return out.select(*columns)
