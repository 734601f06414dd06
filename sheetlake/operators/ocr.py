"""Read text blocks to number candidates and target crops. Engines attach as sources of read rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from .review import dimension_keys

#: Fixed value: why a target was picked.
SELECTED = "High-confidence OCR numeric candidate was not found in the full-page extraction."
LEAST_CONFIDENCE = 0.75


def blocks(read: DataFrame, scope: list[str]) -> DataFrame:
    """scope, id, page, text, x, y, width, height, source_ref, engine, confidence, elapsed.

    ``read`` has scope, page, ordinal (from 1 in the order of reading),
    polygon (array of points), text, confidence, source_ref, engine and
    elapsed: what an engine or a recording gives. Rows without a text or a
    proper polygon are left out; the others keep their ordinal.
    """
    box = X.polygon_box(F.col("polygon"))
    rows = read.withColumn("box", box).filter("box IS NOT NULL AND text IS NOT NULL")
    return rows.select(*scope, F.format_string("page_%03d_ocr_%03d", F.col("page").cast("int"), F.col("ordinal").cast("int")).alias("id"), "page", "text", "box.*", "source_ref", "engine", F.col("confidence").cast("double").alias("confidence"), "elapsed")


def full_page_keys(products: DataFrame, scope: list[str]) -> DataFrame:
    """scope, keys: all forms of the values and raw texts of a product's dimensions."""
    return products.select(*scope, F.array_distinct(F.flatten(F.transform("dimensions", dimension_keys))).alias("keys"))


def candidates(blocks_: DataFrame, products: DataFrame, scope: list[str]) -> DataFrame:
    """The blocks that may be numbers: normalised, classified, and whether the full page has them."""
    known = full_page_keys(products, scope)
    known = known.select(*[F.col(c).alias(f"_{c}") for c in scope], "keys")
    on = F.lit(True)
    for c in scope:
        on &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    rows = blocks_.filter(X.is_numeric_candidate(F.col("text"))).join(known, on, "left")
    text = X.ocr_text(F.col("text"))
    supported = F.coalesce(F.arrays_overlap(X.comparison_keys(text), F.col("keys")), F.lit(False))
    return rows.select(
        *scope, F.col("id").alias("ocr_block_id"), "page", "text", text.alias("normalized_text"), "x", "y", "width", "height", "confidence",
        X.ocr_class(F.col("text")).alias("classification"), F.when(supported, "supported").otherwise("not_found_in_full_page").alias("full_page_status"),
    )


def is_target(status: Column, confidence: Column, normalized: Column, least: float = LEAST_CONFIDENCE) -> Column:
    return (status == "not_found_in_full_page") & F.coalesce(confidence >= least, F.lit(False)) & ~X.is_weak(normalized)


def targets(candidates_: DataFrame, images: DataFrame, scope: list[str], least: float = LEAST_CONFIDENCE) -> DataFrame:
    """A row per target crop: id, box, the candidate it stands for.

    ``images`` has scope, page, image_width, image_height and source_ref. The
    numbers in the ids count all selected candidates of a document in order of
    their blocks, also those without an image or a proper box.
    """
    picked = candidates_.filter(is_target(F.col("full_page_status"), F.col("confidence"), F.col("normalized_text"), least))
    order = Window.partitionBy(*scope).orderBy("page", F.length("ocr_block_id"), "ocr_block_id")  # one document's candidates
    picked = picked.withColumn("n", F.row_number().over(order)).join(images, [*scope, "page"])
    box = X.crop_box(*[F.col(c) for c in ("x", "y", "width", "height", "image_width", "image_height")])
    old = F.struct("x", "y", "width", "height").alias("ocr_bbox")
    made = picked.withColumn("bbox", box).filter("bbox IS NOT NULL")
    return made.select(
        *scope, F.format_string("page_%03d_ocr_target_%03d", F.col("page").cast("int"), "n").alias("id"), F.lit("ocr_target_crop").alias("type"), "page", "bbox", old, F.col("ocr_block_id").alias("source_ocr_block_id"),
        "text", "normalized_text", "classification", "full_page_status", "source_ref", "confidence", F.lit(X.CROP_PADDING).alias("padding_px"), F.lit(SELECTED).alias("selection_reason"),
    )
