"""Names and places of outputs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import exprs as X


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def output_name(path: Column) -> Column:
    return X.output_slug(stem(path))


def raw_response(internal: str, slug: Column) -> Column:
    return F.format_string(f"{internal}/%s.raw_response.txt", slug)


def page_raw_response(internal: str, slug: Column, page: Column) -> Column:
    """Page 1 keeps the base name."""
    return F.when(page == 1, raw_response(internal, slug)).otherwise(F.format_string(f"{internal}/%s_page_%03d.raw_response.txt", slug, page.cast("int")))


def part_raw_response(internal: str, slug: Column, part_id: Column) -> Column:
    """Of a tile or a target."""
    return F.format_string(f"{internal}/%s_%s.raw_response.txt", slug, part_id)


def now_utc() -> Column:
    """The time of the query in UTC to the second, ISO 8601."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
