"""The review document of each product: header, extraction, counts and what needs a look, as one nested row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths

HEADER = ("source_file", "brand_name", "product_name", "document_name", "revision", "revision_date", "sheet", "size", "scale")
COUNTED = ("rendered_pages", "raw_ocr_blocks", "ocr_candidates", "ocr_target_crops", "ocr_target_refinements", "metadata_merges", "tile_extractions")
LISTED = ("metadata_merges", "merge_ready", "needs_review", "tile_only_candidates", "duplicate_candidate_groups")


def with_evidence(products: DataFrame, evidence: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """``products`` with n_<name> of every table of ``evidence``, and its rows in order of ``ord`` as JSON if it is to be listed.

    The tables have the columns ``keys`` and ``ord``. Each is brought to one
    row per document before it is joined; what is listed is what one
    document's review holds.
    """
    out = products
    for name, rows in evidence.items():
        per = [F.count("*").alias(f"n_{name}")]
        if name in LISTED:
            rest = [c for c in rows.columns if c not in (*keys, "ord")]
            entry = F.struct(F.col("ord"), F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("entry"))
            per.append(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["entry"]).alias(name))
        out = out.join(rows.groupBy(*keys).agg(*per), keys, "left")
    return out


def reviews(products: DataFrame, evidence: dict[str, DataFrame] | None = None, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """One row per product: the columns ``keys``, product, extraction, counts, review, tile_review.

    ``products`` has ``keys``, the fields of parsed products and ``status``;
    extractor, model and error are null where absent. Tables missing from
    ``evidence`` count 0 and list nothing.
    """
    evidence = evidence or {}
    joined = with_evidence(products, evidence, list(keys))
    given = lambda n: F.col(n) if n in products.columns else F.lit(None).cast("string")
    number = lambda n: (F.coalesce(F.col(f"n_{n}"), F.lit(0)) if n in evidence else F.lit(0)).cast("long")
    listed = lambda n: F.coalesce(F.col(n), F.array().cast("array<string>")) if n in evidence else F.array().cast("array<string>")
    notes = F.coalesce(F.json_array_length("notes"), F.lit(0)).cast("long")
    counts = [F.size(n).cast("long").alias(n) for n in ("dimensions", "dimension_tables", "tables")] + [notes.alias("notes"), F.size("warnings").cast("long").alias("product_warnings")]
    return joined.select(
        *keys, F.struct(*[F.col(n) for n in HEADER]).alias("product"),
        F.struct(F.col("status"), *[given(n).alias(n) for n in ("extractor", "model", "error")]).alias("extraction"),
        F.struct(*counts, *[number(n).alias("pages" if n == "rendered_pages" else n) for n in COUNTED]).alias("counts"),
        F.struct(*[listed(n).alias("applied_merges" if n == "metadata_merges" else n) for n in LISTED[:3]], F.col("warnings").alias("product_warnings")).alias("review"),
        F.struct(*[listed(n).alias(n) for n in LISTED[3:]]).alias("tile_review"),
    )


#: What an audit document lists, in this order.
AUDITED = ("regions", "tiles", "raw_ocr_blocks", "ocr_candidates", "ocr_target_crops", "ocr_target_refinements", "metadata_merges", "page_extractions", "tile_extractions", "rendered_pages")
#: Fixed value: what is not done with what was read.
UNCERTAIN = "Dimension merge from OCR target refinement and region-specific semantic extraction are not implemented yet."


def audits(products: DataFrame, parts: dict[str, DataFrame], keys: tuple[str, ...] = ("path",), internal: str = "internal") -> DataFrame:
    """One row per product with all that led to it: keys, places, document, extraction, the lists of ``AUDITED``, summaries, warnings.

    ``parts`` has tables with ``keys`` and ``ord`` for the lists (a list is
    JSON in order of ``ord``; a missing table gives an empty one), and, as
    ``tile_summary`` and ``refinement_summary``, a row per document. Each
    table is brought to one row per document before it is joined.
    """
    out = products
    for name in AUDITED:
        if name in parts:
            rest = [c for c in parts[name].columns if c not in (*keys, "ord")]
            entry = F.struct(F.col("ord"), F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("entry"))
            lists = parts[name].groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["entry"]).alias(f"_{name}"))
            out = out.join(lists, list(keys), "left")
    for name in ("tile_summary", "refinement_summary"):
        if name in parts:
            rest = [c for c in parts[name].columns if c not in keys]
            out = out.join(parts[name].select(*keys, F.struct(*rest).alias(f"_{name}")), list(keys), "left")
    given = lambda n: F.col(n) if n in products.columns else F.lit(None).cast("string")
    listed = lambda n: F.coalesce(F.col(f"_{n}"), F.array().cast("array<string>")) if n in parts else F.array().cast("array<string>")
    slug = paths.output_name(F.col(keys[0]).cast("string"))
    place = lambda end: F.format_string(f"{internal}/%s.{end}", slug)
    return out.select(
        *keys, F.lit("0.1.0").alias("schema_version"), F.format_string("products/%s.json", slug).alias("product_json_path"), place("tile_summary.json").alias("tile_summary_path"), place("vlm_prompt.txt").alias("vlm_prompt_path"),
        F.when(given("raw_response").isNotNull(), paths.raw_response(internal, slug)).alias("raw_response_path"),
        F.struct(*[given(n).alias(n) for n in ("extractor", "model", "think", "status", "error")], *([F.col("validation_warnings")] if "validation_warnings" in products.columns else [])).alias("extraction"),
        F.struct(F.col(keys[0]).cast("string").alias("source_path"), paths.file_name(F.col(keys[0]).cast("string")).alias("original_filename"), given("fingerprint").alias("fingerprint"), paths.now_utc().alias("processed_at")).alias("document"),
        *[listed(n).alias(n) for n in AUDITED], *[F.col(f"_{n}").alias(n) for n in ("tile_summary", "refinement_summary") if n in parts], F.col("warnings"),
        F.array(F.struct(F.lit("semantic_extraction").alias("field"), F.lit(UNCERTAIN).alias("reason"), F.lit(0.0).alias("confidence"))).alias("uncertain_fields"),
    )
