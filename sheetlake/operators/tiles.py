"""Pages to regions and overlapping tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X


def tiles(pages: DataFrame, keys: list[str], tile: int = X.TILE, overlap: int = X.OVERLAP, least: int = X.MIN_EDGE) -> DataFrame:
    """keys, page, tile_id, ordinal, x, y, width, height: row by row over each page with a size."""
    w, h = F.col("width").cast("int"), F.col("height").cast("int")
    sized = pages.filter((w > 0) & (h > 0)).select(*keys, "page", w.alias("w"), h.alias("h"))
    rows = sized.select("*", F.posexplode(X.axis_positions(F.col("h"), tile, overlap, least)).alias("r", "y"))
    cells = rows.select("*", F.size(X.axis_positions(F.col("w"), tile, overlap, least)).alias("nx"), F.posexplode(X.axis_positions(F.col("w"), tile, overlap, least)).alias("c", "x"))
    ordinal = F.col("r") * F.col("nx") + F.col("c") + 1
    return cells.select(
        *keys, "page", F.format_string("page_%03d_tile_%03d", F.col("page").cast("int"), ordinal).alias("tile_id"), ordinal.alias("ordinal"), "x", "y",
        F.least(F.lit(tile), F.col("w") - F.col("x")).alias("width"), F.least(F.lit(tile), F.col("h") - F.col("y")).alias("height"),
    )


def full_page_regions(pages: DataFrame, keys: list[str]) -> DataFrame:
    """A region for each page; its box is null where the size is unknown."""
    page = F.coalesce(F.col("page").cast("int"), F.lit(1))
    known = F.col("width").isNotNull() & F.col("height").isNotNull()
    return pages.select(
        *keys, F.format_string("page_%03d_region_001", page).alias("region_id"), F.lit("full_page").alias("type"), page.alias("page"),
        *[F.when(known, v).cast("int").alias(n) for n, v in (("x", F.lit(0)), ("y", F.lit(0)), ("w", F.col("width")), ("h", F.col("height")))], F.lit(1.0).alias("confidence"),
    )
