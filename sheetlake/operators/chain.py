"""From files to products, reviews and audits: pages, then tiles, then targets, each asked with what came before.

All of a batch goes through each step at once. Answers come from a recording
or from the ledger of calls; what a step has parsed is written before the next
one uses it.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, prompts
from ..sources import outputs, providers
from . import crops, documents, evidence, extract, ledger, ocr, parse, review, tiles

# What a product is warned of.
MANY_PAGES = "PDF has multiple pages; product JSON uses page 1 until merge behavior is implemented."
CROPS_LOCAL_ONLY = "Crop extraction is currently implemented for Ollama only."
CROPS_SKIPPED = "Crop extraction was requested but skipped because no VLM extractor is enabled."
TARGETS_SKIPPED = "OCR target refinement was skipped because no VLM extractor is enabled."
SCOPE = ["path"]


@dataclass
class Inputs:
    """What a batch works with. ``files`` has path, filename, fingerprint and image (width, height; null if unknown)."""

    files: DataFrame
    place: str  # below which this batch writes what it has made
    extractor: str = "none"
    model: str | None = None
    recorded: DataFrame | None = None  # see sources.files.recorded
    ask: providers.Ask | None = None
    images: DataFrame | None = None  # image_path, image: what is sent to be read
    rendered: DataFrame | None = None  # path, page, image_path, width, height: pages that a renderer made
    texts: DataFrame | None = None  # see sources.files.recorded_texts; a reader program ran if given
    crops: bool = False  # make tile boxes
    extract_crops: bool = False  # and read them
    calls: dict = field(default_factory=dict)  # passed to the ledger: wave, lanes, per_second, tries, pause

    @property
    def asks(self) -> bool:
        return self.recorded is not None or self.ask is not None

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.place}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{self.place}/{name}")


def _pictures(x: Inputs, boxes: DataFrame, pages: DataFrame, name: str) -> DataFrame:
    """path, id, image_path, image, error: the crops of ``boxes`` (path, page, id, x, y, width, height), named after their file and id."""
    named = boxes.join(pages.select("path", "page", "image_path"), ["path", "page"])
    made = crops.cut(named.select("image_path", F.to_json(F.struct("path", "id")).alias("id"), "x", "y", "width", "height"))
    of = F.from_json("id", "path string, id string")
    made = made.select(of["path"].alias("path"), of["id"].alias("id"), F.concat_ws("#", of["path"], of["id"]).alias("image_path"), F.col("crop").alias("image"), "error")
    return x.write(made, name)


def answers(x: Inputs, requests: DataFrame, step: str, images: DataFrame | None = None) -> DataFrame:
    """Answers to ``requests`` (request_id, path, page, part_id, prompt, image_path): recorded ones, and calls for the others.

    Calls send the pictures of ``images`` (image_path, image), those of the
    pages if there are none; a request without a picture is not made.
    Of several recordings of a request the last in the order of their texts
    counts; one with an error or without a text has failed.
    """
    none = requests.sparkSession.createDataFrame([], providers.SCHEMA)
    if x.recorded is not None:
        last = x.recorded.groupBy("file_name", "page", "part_id").agg(F.max(F.struct("raw_response", "error", "truncated")).alias("r"))
        named = requests.select("request_id", paths.file_name(F.col("path")).alias("file_name"), "page", "part_id")
        same = F.lit(True)
        for c in ("file_name", "page", "part_id"):
            same &= named[c].eqNullSafe(last[c])
        status = F.when(F.col("r.error").isNotNull() | F.col("r.raw_response").isNull(), "failed").otherwise("completed")
        given = named.join(last, same).select("request_id", status.alias("status"), "r.*")
    else:
        given = none
    images = x.images if images is None else images.filter("image IS NOT NULL").select("image_path", "image")
    if x.ask is None or images is None:
        return given
    open_ = requests.join(given.select("request_id"), "request_id", "left_anti").join(x.files.select("path", "fingerprint"), "path")
    open_ = open_.withColumn("model", F.lit(x.model)).withColumn("key", ledger.key("request_id", "fingerprint", "model", "prompt"))
    made = ledger.answered(open_, images, x.ask, f"{x.place}/calls", f"{x.place}/asked/{step}-{uuid.uuid4().hex}", **x.calls)
    return given.unionByName(made)


def _listed(df: DataFrame, order: Column) -> DataFrame:
    return df.withColumn("ord", order)


def run(x: Inputs) -> dict[str, DataFrame]:
    """products, reviews, audits, pages, tiles, tile_crops, target_crops, tile_runs and refinements (None where there are none) of a batch.

    A product has path, file_name, fingerprint, error, answered, failed, the
    parsed fields, status and warnings. It is failed if page 1 was asked and
    gave no text.
    """
    images = extract.page_images(x.files, x.rendered)
    asked = extract.page_requests(images)
    got = answers(x, asked, "pages")
    runs = x.write(extract.product_runs(asked, got).join(images.select("path", "page", "image_path"), ["path", "page"]), "pages")
    products = x.write(_products(x, runs), "parsed")
    usable = products.filter("NOT failed")

    known = x.files.filter("image IS NOT NULL").select("path", F.lit(1).alias("page"), "image.width", "image.height")
    if x.rendered is not None:
        known = known.unionByName(x.rendered.select("path", F.col("page").cast("int").alias("page"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height")))
    sized = images.join(known, ["path", "page"], "left")
    parts: dict[str, DataFrame] = {"regions": _listed(tiles.full_page_regions(sized, SCOPE), F.col("page"))}
    if x.rendered is not None:
        parts["rendered_pages"] = _listed(x.rendered, F.col("page"))
    listed: dict[str, DataFrame] = {k: parts[k] for k in ("rendered_pages",) if k in parts}
    parts["page_extractions"] = _listed(runs.select("path", "page", "image_path", "status", "error", "validation_warnings"), F.col("page"))

    tile_runs = refinements = tile_crops = target_crops = None
    if x.crops or x.extract_crops:
        boxes = x.write(tiles.tiles(sized, SCOPE), "tiles")
        tile_crops = _pictures(x, boxes.withColumnRenamed("tile_id", "id"), images, "tile-crops")
        parts["tiles"] = _listed(boxes, F.struct("page", "ordinal"))
        if x.extract_crops and x.asks and x.extractor in ("ollama", "none"):
            wanted = extract.tile_requests(boxes.withColumn("image_path", F.concat_ws("#", "path", "tile_id")))
            read = extract.product_runs(wanted, answers(x, wanted, "tiles", tile_crops)).withColumnRenamed("part_id", "tile_id")
            tile_runs = x.write(read.join(boxes.select("path", "tile_id", "ordinal", "x", "y", "width", "height"), ["path", "tile_id"]), "tile-runs")
            order = F.struct("page", "ordinal")
            parts["tile_extractions"] = listed["tile_extractions"] = _listed(tile_runs.select("path", "tile_id", "page", "x", "y", "width", "height", "status", "error", "validation_warnings", "ordinal"), order).drop("ordinal")
            candidates = x.write(evidence.tile_candidates(tile_runs.filter("status IN ('completed', 'validation_failed')"), SCOPE), "tile-candidates")
            summary = evidence.tile_summary(candidates, x.write(evidence.full_page_candidates(usable, SCOPE), "page-candidates"), SCOPE)
            parts["tile_summary"] = x.write(summary["counts"], "tile-summary")
            listed["tile_only_candidates"] = _listed(summary["tile_only"].select("path", "candidate_id", "raw_text", "value", "type", "label", "classification", "review_action"), F.col("candidate_id"))
            listed["duplicate_candidate_groups"] = _listed(summary["groups"].select("path", "k_page", "k_value", "k_type", "k_label", "k_quantity", "members", "first_id", "score", "score_reasons", "classification", "review_action"), F.struct("first_id", "k_value"))
    if x.texts is not None:
        read = x.texts.join(x.files.select("path", F.col("filename").alias("file_name")), "file_name").drop("file_name")
        blocks = x.write(ocr.blocks(read, SCOPE), "text-blocks")
        found = x.write(ocr.candidates(blocks, usable, SCOPE), "text-candidates")
        pictures = sized.filter("width > 0 AND height > 0").select("path", "page", F.col("width").alias("image_width"), F.col("height").alias("image_height"), "source_ref")
        targets = x.write(ocr.targets(found, pictures, SCOPE), "targets")
        target_crops = _pictures(x, targets.select("path", "page", "id", "bbox.*"), images, "target-crops")
        block = F.struct("page", F.length("id"), "id")
        parts["raw_ocr_blocks"] = listed["raw_ocr_blocks"] = _listed(blocks, block)
        parts["ocr_candidates"] = listed["ocr_candidates"] = _listed(found, F.struct("page", F.length("ocr_block_id"), "ocr_block_id"))
        parts["ocr_target_crops"] = listed["ocr_target_crops"] = _listed(targets, block)
        if x.asks:
            wanted = extract.target_requests(targets.withColumn("image_path", F.concat_ws("#", "path", "id")))
            read = extract.refinement_runs(wanted, answers(x, wanted, "targets", target_crops))
            refinements = x.write(read.join(targets.select("path", F.col("id").alias("target_id"), F.col("text").alias("ocr_text")), ["path", "target_id"]), "refinements")
            order = F.struct("page", F.length("target_id"), "target_id")
            parts["ocr_target_refinements"] = listed["ocr_target_refinements"] = _listed(refinements, order)
            judged = x.write(review.judged(_listed(refinements, order), usable, SCOPE), "judged")
            parts["refinement_summary"] = review.refinement_summary(judged, SCOPE)
            items = review.review_items(judged, SCOPE)
            for name in ("merge_ready", "needs_review"):
                listed[name] = items.filter(F.col("list") == name).drop("list")
    reviews = documents.reviews(usable, listed, tuple(SCOPE))
    audits = documents.audits(usable, parts, tuple(SCOPE))
    return {"products": products, "reviews": x.write(reviews, "reviews"), "audits": x.write(audits, "audits"), "tiles": parts.get("tiles"), "pages": runs, "tile_crops": tile_crops, "target_crops": target_crops, "tile_runs": tile_runs, "refinements": refinements}


def product_text(products: DataFrame) -> Column:
    """The JSON of each row's product."""
    fields = ("source_file", *parse.SCALARS, "dimensions", "dimension_tables", "tables", "schematics", "tolerances", "notes", "warnings")
    return outputs.product_json(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))


def texts(made: dict[str, DataFrame]) -> DataFrame:
    """file, text (bytes), path: every document of a batch under the name of its drawing; products, prompts, audits, reviews, summaries, raw responses and crops."""
    slug = paths.output_name(F.col("path"))
    named = lambda text: F.format_string(text, slug)
    whole = lambda df, *but: outputs.indented_json(F.to_json(F.struct(*[c for c in df.columns if c not in but]), {"ignoreNullFields": "false"}))
    p, r, a = (made[n] for n in ("products", "reviews", "audits"))
    p = p.filter("NOT failed")
    rows = [
        p.select(named("products/%s.json").alias("file"), product_text(p).alias("text"), "path"), p.select(named("internal/%s.vlm_prompt.txt").alias("file"), prompts.page(F.col("file_name")).alias("text"), "path"),
        a.select(named("internal/%s.internal.json").alias("file"), whole(a, "path").alias("text"), "path"), r.select(named("internal/reviews/%s.review.json").alias("file"), whole(r, "path").alias("text"), "path"),
        made["pages"].select(paths.page_raw_response("internal", slug, F.col("page")).alias("file"), F.col("raw_response").alias("text"), "path"),
    ]
    if "tile_summary" in a.columns:
        rows.append(a.select(named("internal/%s.tile_summary.json").alias("file"), outputs.indented_json(F.to_json("tile_summary")).alias("text"), "path"))
    for name, part, folder in (("tile_runs", "tile_id", "tile_responses"), ("refinements", "target_id", "ocr_target_responses")):
        if made[name] is not None:
            rows.append(made[name].select(paths.part_raw_response(f"internal/{folder}", slug, F.col(part)).alias("file"), F.col("raw_response").alias("text"), "path"))
    rows = [r.withColumn("text", F.col("text").cast("binary")) for r in rows]
    for name, folder in (("tile_crops", "crops"), ("target_crops", "ocr_target_crops")):
        if made[name] is not None:
            rows.append(made[name].select(F.format_string(f"internal/{folder}/%s_%s.png", slug, "id").alias("file"), F.col("image").alias("text"), "path"))
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def _products(x: Inputs, runs: DataFrame) -> DataFrame:
    """The product of each file: what page 1 gave, or the default one, with the warnings of the batch."""
    pages = runs.groupBy("path").agg(F.count("*").alias("pages"))
    told = F.col("pdf.page_count") if "pdf" in x.files.columns else F.lit(None).cast("int")
    first = extract.first_pages(runs, x.extractor)
    said = [F.when(F.greatest("pages", "told") > 1, MANY_PAGES)]
    if x.extract_crops:
        said.append(F.lit(CROPS_SKIPPED) if not x.asks else F.lit(CROPS_LOCAL_ONLY) if x.extractor not in ("ollama", "none") else F.lit(None).cast("string"))
    if x.texts is not None and not x.asks:
        said.append(F.lit(TARGETS_SKIPPED))
    own = F.when(F.col("status") == "not_run", F.array(F.lit(parse.PLACEHOLDER))).otherwise(F.col("warnings"))
    rows = first.join(pages, "path").join(x.files.select("path", "fingerprint", told.alias("told")), "path")
    answered = F.col("status") != "not_run"
    return rows.withColumns({"answered": answered, "failed": answered & ~F.col("status").isin("completed", "validation_failed"), "warnings": F.concat(own, F.array_compact(F.array(*said))), "extractor": F.lit(x.extractor), "model": F.lit(x.model)}).drop("pages", "told", "request_id", "page", "part_id", "image_path")
