"""Prompts for pages, tiles and targets, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import exprs as X

SCALARS = ("brand_name", "product_name", "document_name", "drawing_number", "revision", "revision_date", "sheet", "size", "scale")

COMMON = (
    "Give what is printed on the drawing and nothing else; do not guess, compute or translate.",
    "Use null for a value that is missing or cannot be read, and an empty list for a list without entries.",
    "Never take a name from the file name.",
    "Keep texts as they are written, with signs, decimal commas and units; raw_text is the whole printed dimension.",
    f"type of a dimension is one of: {', '.join(X.DIMENSION_TYPES)}.",
    "quantity is the count before or after a dimension, such as 4 in 4x; null if there is none.",
    "label is a name printed beside the dimension; it does not repeat the dimension.",
)
PAGE = (
    "Read the title block for the names, revision, sheet, size and scale; size is a paper size such as A3 and scale a ratio such as 1:2.",
    f"type of a table is one of: {', '.join(X.TABLE_TYPES)}.",
    "Give each row of a table as cells, each with its column and its value, in the order of the columns.",
    "Tables of dimensions go to dimension_tables, all others to tables, circuits and wiring to schematics.",
)
TILE = (
    "The picture is a part of a page; what is cut off at its edge is left out.",
    "Names and title block values only if they stand wholly in this part.",
)
TARGET = (
    "The picture is cut out around one text that a reader program found; the text may have been read wrongly.",
    f"classification says what the text is: {', '.join(X.CLASSES)}.",
    f"local_context says where it stands: {', '.join(X.CONTEXTS)}.",
    "visual_text is what you read yourself; ocr_text_supported says whether it agrees with the hint.",
    "confidence is a number from 0 to 1.",
)


def rules(lines) -> str:
    """One line each, with a dash."""
    return "\n".join(f"- {x}" for x in lines)


def product_schema() -> str:
    """What a product's JSON looks like."""
    dimension = '{"raw_text": string, "value": string | number, "unit": string | null, "type": string, "quantity": number | null, "label": string | null, "context": string | null}'
    rows = '"rows": [{"label": string | null, "cells": [{"column": string, "value": string | number}]}]'
    lines = [f'"{n}": string | null' for n in SCALARS] + [
        f'"dimensions": [{dimension}]', f'"dimension_tables": [{{"title": string | null, "context": string | null, {rows}}}]',
        f'"tables": [{{"title": string | null, "context": string | null, "type": string, {rows}}}]',
        '"schematics": [{"title": string | null, "context": string | null, "components": [string], "parameters": [{"label": string, "value": string, "context": string | null}]}]',
        '"tolerances": []', '"notes": [string]', '"warnings": [string]',
    ]
    return "{\n" + ",\n".join(f"  {x}" for x in lines) + "\n}"


def refinement_schema() -> str:
    """What a refinement's JSON looks like."""
    fields = {
        "target_id": "string", "page": "number", "classification": "string", "is_product_dimension": "boolean | null", "raw_text": "string | null", "visual_text": "string | null", "ocr_text_supported": "boolean | null",
        "local_context": "string", "visible_label": "string | null", "dimension": "object | null", "metadata": '{"field": string, "value": string} | null', "confidence": "number", "warnings": "[string]",
    }
    return "{\n" + ",\n".join(f'  "{n}": {t}' for n, t in fields.items()) + "\n}"


def _prompt(task: str, lines, schema: str, *facts: Column) -> Column:
    head = F.lit(f"{task}\nAnswer with one JSON object only.\n\nRules:\n{rules(lines)}\n\n")
    return F.concat(head, F.concat_ws("\n", *facts), F.lit(f"\n\nThe JSON object:\n{schema}\n"))


def _fact(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), F.coalesce(value.cast("string"), F.lit("unknown")))


def _box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.format_string("x=%d, y=%d, width=%d, height=%d", *[c.cast("int") for c in (x, y, width, height)])


def page(source: Column) -> Column:
    return _prompt("Read this page of a technical drawing.", COMMON + PAGE, product_schema(), _fact("Source file", source))


def tile(source: Column, tile_id: Column, page_: Column, x: Column, y: Column, width: Column, height: Column) -> Column:
    facts = (_fact("Source file", source), _fact("Tile", tile_id), _fact("Page", page_), _fact("Place on the page in pixels", _box(x, y, width, height)))
    return _prompt("Read this part of a page of a technical drawing.", COMMON + PAGE + TILE, product_schema(), *facts)


def target(source: Column, target_id: Column, page_: Column, bbox: Column, text: Column, classification: Column) -> Column:
    box = _box(bbox["x"], bbox["y"], bbox["width"], bbox["height"])
    facts = (_fact("Source file", source), _fact("Target", target_id), _fact("Page", page_), _fact("Place on the page in pixels", box), _fact("Text as read by the program", text), _fact("Taken for", classification))
    return _prompt("Say what the marked text of a technical drawing is.", COMMON[:4] + TARGET, refinement_schema(), *facts)
