"""Refinements: coverage, summary, metadata comparison, routing and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X

MERGE_READY, SAFE = 0.85, 0.9
#: Product fields that a refinement may fill, and what a merge or an item for review says.
MERGEABLE = ("brand_name", "product_name", "document_name", "drawing_number", "revision", "revision_date", "sheet", "size", "scale")
FILLED = "Filled empty product metadata from high-confidence OCR target refinement without overwriting an existing value."
MENDED = "Corrected product scale punctuation from high-confidence OCR target refinement without changing the ratio digits."
REASONS = {
    "needs_review:text_conflict": "Target refinement text does not cleanly support the OCR hint, so the dimension candidate needs review.",
    "needs_review:unsafe": "Target refinement found a possible product dimension, but the dimension type or value is not safe enough for merge-ready.",
    "merge_ready:confident": "High-confidence target refinement found a product dimension that is not covered by full-page extraction.",
    "needs_review:low_confidence": "Target refinement found a possible product dimension, but confidence is below the merge-ready threshold.",
    "needs_review:conflict": "Target refinement conflicts with the product JSON metadata.",
    "needs_review:missing_in_product": "Target refinement found metadata that is missing from the product JSON.",
}
ITEM = ("target_id", "ocr_text", "visual_text", "ocr_text_supported", "local_context", "visible_label")


def value_keys(value: Column) -> Column:
    """All forms of a text under which it may match; none for null."""
    return F.coalesce(X.comparison_keys(X.ocr_text(value)), F.array().cast("array<string>"))


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def dimension_keys(d: Column) -> Column:
    return F.array_union(value_keys(_text(d["raw_text"])), value_keys(_text(d["value"])))


def product_coverage(products: DataFrame, scope: list[str]) -> DataFrame:
    """scope, dimension_keys, table_keys of each product.

    Rows of a table that stands as columns and bare values, without a label in
    any row, count for nothing.
    """
    own = F.array_distinct(F.flatten(F.transform("dimensions", dimension_keys)))

    def of_table(t: Column) -> Column:
        bare = t["columns"].isNotNull() & F.forall(t["rows"], lambda r: r["label"].isNull())
        values = F.flatten(F.transform(t["rows"], lambda r: F.coalesce(F.transform(r["cells"], lambda c: _text(c["value"])), F.transform(r["values"], _text), F.array().cast("array<string>"))))
        return F.when(bare, F.array().cast("array<string>")).otherwise(F.flatten(F.transform(values, value_keys)))

    return products.select(*scope, own.alias("dimension_keys"), F.array_distinct(F.flatten(F.transform("dimension_tables", of_table))).alias("table_keys"))


def coverage(keys: Column, dimension_keys: Column, table_keys: Column) -> Column:
    """Where a refinement's keys are known already: dimensions, then tables, else new."""
    held = lambda c: F.coalesce(F.arrays_overlap(keys, c), F.lit(False))
    return F.when(held(dimension_keys), "dimensions").when(held(table_keys), "dimension_tables").otherwise("new")


def metadata_status(read: Column, product: Column) -> Column:
    r, p = X.metadata_value(read), X.metadata_value(product)
    return F.when(read.isNull(), None).when(p.isNull(), "missing_in_product").when(F.coalesce(r == p, F.lit(False)), "supported").otherwise("conflict")


def text_conflict(supported: Column, visual: Column, ocr: Column) -> Column:
    v, o = X.metadata_value(visual), X.metadata_value(ocr)
    return F.coalesce(~supported, F.lit(False)) | F.coalesce(v != o, F.lit(False))


def route(conflict: Column, type_: Column, raw: Column, value: Column, confidence: Column) -> Column:
    """Decision on a new dimension: a conflict beats an unsafe type, which beats confidence."""
    safe = F.coalesce(~type_.isin("pattern", "unknown"), F.lit(False)) & F.coalesce(raw != "", F.lit(False)) & F.coalesce(value != "", F.lit(False))
    return F.when(conflict, "needs_review:text_conflict").when(~safe, "needs_review:unsafe").when(F.coalesce(confidence >= MERGE_READY, F.lit(False)), "merge_ready:confident").otherwise("needs_review:low_confidence")


def judged(refinements: DataFrame, products: DataFrame, scope: list[str]) -> DataFrame:
    """Each refinement with kind, coverage, field, product_value and metadata_status.

    ``refinements`` has scope, ord, target_id, ocr_text, status and the parsed
    fields; ``products`` the products' fields. kind is what the summary counts
    it as: failed, dimension, metadata, note, irrelevant or uncertain.
    """
    usable = F.coalesce(F.col("status").isin("completed", "validation_failed"), F.lit(False))
    class_ = F.col("classification")
    kind = F.when(~usable, "failed").when(class_.isin("dimension", "metadata", "note", "irrelevant"), class_).otherwise("uncertain")
    known = product_coverage(products, scope)
    fields = products.select(*scope, F.create_map(*[x for n in MERGEABLE for x in (F.lit(n), _text(F.col(n)))]).alias("fields"))
    out = refinements.withColumn("kind", kind)
    for side in (known, fields):
        names = [F.col(c).alias(f"_{c}") if c in scope else F.col(c) for c in side.columns]
        on = F.lit(True)
        for c in scope:
            on &= F.col(c).eqNullSafe(F.col(f"_{c}"))
        out = out.join(side.select(*names), on, "left").drop(*[f"_{c}" for c in scope])
    product_dimension = (F.col("kind") == "dimension") & F.coalesce(F.col("is_product_dimension"), F.lit(False))
    field = X.metadata_field(F.col("metadata.field"))
    told = (F.col("kind") == "metadata") & field.isNotNull() & F.col("metadata.value").isNotNull()
    keys = F.when(F.col("dimension").isNotNull(), dimension_keys(F.col("dimension"))).otherwise(F.array().cast("array<string>"))
    value = F.when(told, F.element_at("fields", field))
    return out.withColumns({
        "coverage": F.when(product_dimension, coverage(keys, F.col("dimension_keys"), F.col("table_keys"))), "field": F.when(told, field), "product_value": value,
        "refinement_value": F.when(told, F.col("metadata.value")), "metadata_status": F.when(told, metadata_status(F.col("metadata.value"), value)),
    }).drop("dimension_keys", "table_keys", "fields")


def refinement_summary(judged_: DataFrame, scope: list[str]) -> DataFrame:
    """Counts per scope: targets, the six kinds, merge candidates by coverage, metadata candidates."""
    n = lambda k: F.count_if(F.col("kind") == k)
    covered = lambda k: F.count_if(F.col("coverage") == k)
    return judged_.groupBy(*scope).agg(
        F.count("*").alias("targets"), n("dimension").alias("dimensions"), n("metadata").alias("metadata"), n("note").alias("notes"), n("uncertain").alias("uncertain"), n("irrelevant").alias("irrelevant"), n("failed").alias("failed"),
        F.count("coverage").alias("merge_candidates"), covered("dimensions").alias("covered_by_dimensions"), covered("dimension_tables").alias("covered_by_dimension_tables"), covered("new").alias("new_dimension_candidates"),
        F.count("metadata_status").alias("metadata_review_candidates"),
    )


def review_items(judged_: DataFrame, scope: list[str]) -> DataFrame:
    """A row per item that is merge_ready or needs_review: scope, ord, list, kind, reason, what was read and what is known.

    New dimensions are routed by ``route``; metadata needs review where it
    conflicts or is missing in the product. Dimensions come before metadata.
    """
    d = F.col("dimension")
    conflict = text_conflict(F.col("ocr_text_supported"), F.col("visual_text"), F.col("ocr_text"))
    own = route(conflict, d["type"], _text(d["raw_text"]), _text(d["value"]), F.col("confidence"))
    decision = F.when(F.col("coverage") == "new", own).when(F.col("metadata_status").isin("conflict", "missing_in_product"), F.concat(F.lit("needs_review:"), F.col("metadata_status")))
    items = judged_.withColumn("decision", decision).filter("decision IS NOT NULL")
    reasons = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    return items.select(
        *scope, F.struct((F.col("kind") == "metadata").alias("metadata"), F.col("ord").alias("ord")).alias("ord"), F.substring_index("decision", ":", 1).alias("list"), "kind", *ITEM,
        F.when(F.col("kind") == "dimension", d).alias("candidate"), "field", "product_value", "refinement_value", "confidence", F.element_at(reasons, F.col("decision")).alias("reason"),
    )


def safe_merges(products: DataFrame, refinements: DataFrame, scope: list[str]) -> DataFrame:
    """The merges that are safe, in order: scope, ord, field, before, value, reason and the evidence.

    ``products`` has scope, field and value, a row per mergeable field;
    ``refinements`` scope, ord, status, classification, field and value (as
    read), visual_text, confidence, ocr_text_supported, local_context,
    visible_label, target_id and ocr_text. The first fit value fills an empty
    field, and the first one that only mends the punctuation of a scale mends
    it; nothing else is overwritten.
    """
    clean = X.clean_scalar
    fit = refinements.withColumns({"field": X.metadata_field(F.col("field")), "value": clean(F.col("value"))}).filter(
        F.col("status").isin("completed", "validation_failed") & (F.col("classification") == "metadata") & (F.col("confidence") >= SAFE)
        & F.coalesce(F.col("ocr_text_supported"), F.lit(True)) & (clean(F.col("visible_label")).isNotNull() | F.coalesce(F.col("local_context").isin("title_block", "dimension_table", "general_table"), F.lit(False)))
        & F.col("field").isin(*MERGEABLE) & F.col("value").isNotNull() & clean(F.col("visual_text")).isNotNull() & (X.metadata_value(clean(F.col("visual_text"))) == X.metadata_value(F.col("value")))
    )
    by = [*scope, "field"]
    evidence = F.struct("ord", "value", *ITEM, "confidence")
    base = products.select(*by, F.col("value").alias("before")).join(fit.groupBy(*by).agg(F.min_by(evidence, "ord").alias("first")), by)
    empty = X.metadata_value(F.col("before")).isNull()
    base = base.withColumn("now", F.when(empty, F.col("first.value")).otherwise(F.col("before")))
    filled = base.filter(empty).select(*by, "before", F.lit(FILLED).alias("reason"), "first.*")
    scales = fit.filter("field = 'scale'").join(base.select(*by, "now"), by).filter(X.is_scale_correction(X.strip(F.col("now")), F.col("value")))
    mended = scales.groupBy(*by).agg(F.min_by(evidence, "ord").alias("first"), F.first("now").alias("before")).select(*by, "before", F.lit(MENDED).alias("reason"), "first.*")
    return filled.unionByName(mended)


def merged(products: DataFrame, merges: DataFrame, scope: list[str]) -> DataFrame:
    """``products`` (scope, field, value) with the value of the last merge of each field."""
    last = merges.groupBy(*scope, "field").agg(F.max_by("value", F.struct("ord", F.col("reason") == MENDED)).alias("_new"))
    return products.join(last, [*scope, "field"], "left").withColumn("value", F.coalesce("_new", "value")).drop("_new")
