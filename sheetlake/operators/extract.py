"""Requests to a model for pages, tiles and targets, and what its responses come to.

A request is a row with a prompt and an image reference; a response is a row
with its id (see ``sources.providers``). Responses may be recorded as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, prompts
from . import parse

#: The warning for a response that was cut off, and the models of extractors that have a default one.
TRUNCATED = "Extractor response appears to have been cut off at the model's output token limit; the parsed JSON may be missing trailing fields such as later tables, notes, or warnings."
MODELS = {"ollama": "moondream", "anthropic": None}


def resolved_model(extractor: str, model: str | None) -> str | None:
    """The model to ask; a hosted extractor has no default one."""
    return model or MODELS[extractor] if extractor in MODELS else None


def page_images(files: DataFrame, rendered: DataFrame | None = None) -> DataFrame:
    """path, page, image_path, source_ref: the rendered pages of each file, or the file itself as page 1.

    ``rendered`` has path, page and image_path, a row per page that a renderer
    has made.
    """
    own = files.select("path", F.lit(1).alias("page"), F.col("path").alias("image_path"))
    if rendered is not None:
        made = rendered.filter("image_path IS NOT NULL").select("path", F.coalesce(F.col("page").cast("int"), F.lit(1)).alias("page"), "image_path")
        own = made.unionByName(own.join(made.select("path").distinct(), "path", "left_anti"))
    return own.withColumn("source_ref", F.format_string("%s#page=%d", "path", "page"))


def page_requests(images: DataFrame) -> DataFrame:
    """A request for each page image."""
    return images.select("path", "page", F.lit(None).cast("string").alias("part_id"), F.format_string("%s#page=%d", "path", "page").alias("request_id"), prompts.page(paths.file_name(F.col("path"))).alias("prompt"), "image_path")


def tile_requests(tiles: DataFrame) -> DataFrame:
    """A request for each tile: path, page, tile_id, x, y, width, height, image_path."""
    prompt = prompts.tile(paths.file_name(F.col("path")), F.col("tile_id"), F.col("page"), *[F.col(c) for c in ("x", "y", "width", "height")])
    return tiles.select("path", "page", F.col("tile_id").alias("part_id"), F.concat_ws("#", "path", "tile_id").alias("request_id"), prompt.alias("prompt"), "image_path")


def target_requests(targets: DataFrame) -> DataFrame:
    """A request for each target crop: path, id, page, bbox, text, classification, image_path."""
    prompt = prompts.target(paths.file_name(F.col("path")), F.col("id"), F.col("page"), F.col("bbox"), F.col("text"), F.col("classification"))
    return targets.select("path", "page", F.col("id").alias("part_id"), F.concat_ws("#", "path", "id").alias("request_id"), prompt.alias("prompt"), "image_path")


def final_status(given: Column, warnings: Column) -> Column:
    """A completed response with warnings has failed validation; any other status stands."""
    return F.when((given == "completed") & (F.size(warnings) > 0), "validation_failed").otherwise(given)


def product_runs(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """A row per page or tile request: path, page, part_id, status, error, validation_warnings and the product's fields.

    ``responses`` has request_id, status, raw_response, error and truncated. A
    request without a response is not_run. Only completed responses are
    parsed; others keep their text in raw_response and the default product. A
    truncated response adds a warning to both lists, and any warning makes
    validation_failed of completed.
    """
    asked = requests.select("request_id", "path", "page", "part_id").join(responses, "request_id", "left")
    given = F.coalesce(F.col("status"), F.lit("not_run"))
    asked = asked.withColumns({"given": given, "file_name": paths.file_name(F.col("path")), "body": F.col("raw_response"), "raw_response": F.when(given == "completed", F.col("raw_response"))})
    keep = ("request_id", "path", "page", "part_id", "given", "error", "body", "truncated", "file_name")
    made = parse.products(asked, keep, found="validation_warnings")
    return _finished(made)


def refinement_runs(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """A row per target request: path, page, part_id as target_id, status, error, validation_warnings and the refinement's fields."""
    asked = requests.select("request_id", "path", "page", "part_id").join(responses, "request_id", "left")
    given = F.coalesce(F.col("status"), F.lit("not_run"))
    asked = asked.withColumns({"given": given, "body": F.col("raw_response"), "raw_response": F.when(given == "completed", F.col("raw_response"))})
    made = parse.refinements(asked, ("request_id", "path", "page", "part_id", "given", "error", "body", "truncated"), found="validation_warnings")
    return _finished(made).withColumnRenamed("part_id", "target_id")


def _finished(made: DataFrame) -> DataFrame:
    cut = F.when(F.coalesce(F.col("truncated"), F.lit(False)), F.array(F.lit(TRUNCATED))).otherwise(parse.none())
    parsed = F.col("given") == "completed"
    made = made.withColumns({"validation_warnings": F.when(parsed, F.concat("validation_warnings", cut)).otherwise(parse.none()), "warnings": F.when(parsed, F.concat("warnings", cut)).otherwise(parse.none())})
    return made.withColumn("status", final_status(F.col("given"), F.col("validation_warnings"))).drop("given", "truncated").withColumnRenamed("body", "raw_response")


def first_pages(runs: DataFrame, extractor: str) -> DataFrame:
    """The run of page 1 of each file, which makes its product; one that gave none says why in its warnings."""
    failed = ~F.col("status").isin("completed", "validation_failed", "not_run")
    said = F.array(F.format_string(f"{extractor} extraction failed: %s", F.coalesce(F.nullif(F.col("error"), F.lit("")), F.lit("unknown error"))))
    return runs.filter("page = 1").withColumn("warnings", F.when(failed, said).otherwise(F.col("warnings")))
