"""Column expressions of the engine: cleaning, keys, classes and box arithmetic. No UDFs.

Every expression gives null for null unless its docstring says otherwise.
White space and digits are those of Unicode, hence ``(?U)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
SUPPORTED = ("pdf", "png", "jpg", "jpeg", "tif", "tiff")
NULL_WORDS = ("", "null", "none", "n/a", "na", "-")
MISREAD = ("Ã˜", "Ø")
SHEET_SIZES = ("A0", "A1", "A2", "A3", "A4", "A5")
DIMENSION_TYPES = ("linear", "diameter", "radius", "angle", "thread", "pattern", "unknown")
TYPE_ALIASES = {"hole_diameter": "diameter", "pad_diameter": "diameter", "dia": "diameter", "diam": "diameter", "pitch": "pattern"}
TABLE_TYPES = ("pinout_table", "connection_table", "specification_table", "notes_table", "legend_table", "unknown")
CONTEXTS = ("title_block", "dimension_callout", "dimension_table", "general_table", "drawing_view", "note", "unknown")
CLASSES = ("dimension", "metadata", "note", "uncertain", "irrelevant")
UNITS = {
    "mm": ("millimeter", "millimeters", "millimetre", "millimetres", "milimeter", "milimeters", "mm"),
    "deg": ("degree", "degrees", "deg", "°"), "in": ("inch", "inches", "in", '"'), "V": ("volt", "volts", "v"),
    "A": ("amp", "amps", "ampere", "amperes", "a"), "Hz": ("hz", "hertz"), "%": ("%", "percent", "percentage"), "C": ("c", "°c", "celsius"),
}
FIELDS = {
    "brand_name": ("brand", "brand name", "company", "company name", "manufacturer", "manufacturer name", "logo"),
    "scale": ("scale", "drawing scale"), "size": ("size", "sheet size"), "revision": ("revision", "rev"),
    "revision_date": ("revision date", "rev date", "date"), "sheet": ("sheet", "sheet number", "sheet no"),
}
SLUG_NOISE = ("technical", "drawing", "drawings", "page", "sheet", "rev", "revision", "pdf", "jpg", "jpeg", "png", "tif", "tiff")
TILE, OVERLAP, MIN_EDGE = 1024, 256, 384
CROP_PADDING, CROP_MIN, CROP_MAX = 160, 384, 1024


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.element_at(F.create_map(*pairs), key)


def _inverted(table: dict[str, tuple[str, ...]]) -> dict[str, str]:
    return {alias: name for name, aliases in table.items() for alias in aliases}


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"(?U)\s+", " ")


def clean_scalar(c: Column) -> Column:
    """Mended, trimmed; placeholder words become null."""
    t = strip(F.replace(c, *map(F.lit, MISREAD)))
    return F.when(~F.lower(t).isin(*NULL_WORDS), t)


def is_sheet_size(c: Column) -> Column:
    return F.coalesce(F.upper(strip(c)).isin(*SHEET_SIZES), F.lit(False))


def unit(c: Column) -> Column:
    """A known unit's symbol; anything else as it is."""
    return F.coalesce(_lookup(_inverted(UNITS), squeeze(F.replace(F.lower(c), F.lit("."), F.lit("")))), c)


def dimension_type(c: Column) -> Column:
    """One of the allowed types; null and unknown ones are ``unknown``."""
    k = F.replace(F.lower(strip(c)), F.lit(" "), F.lit("_"))
    k = F.coalesce(_lookup(TYPE_ALIASES, k), k)
    return F.when(k.isin(*DIMENSION_TYPES), k).otherwise("unknown")


def table_type(c: Column) -> Column:
    k = F.replace(F.lower(strip(c)), F.lit(" "), F.lit("_"))
    return F.when(k.isin(*TABLE_TYPES), k).otherwise("unknown")


def text_key(c: Column) -> Column:
    return F.nullif(squeeze(F.lower(c)), F.lit(""))


def value_key(c: Column) -> Column:
    return F.replace(F.lower(strip(c)), F.lit(","), F.lit("."))


def quantity_key(c: Column) -> Column:
    """Text of a whole number without its fraction; other text in lower case."""
    t = F.lower(strip(c))
    return F.nullif(F.regexp_replace(t, r"^(-?\d+)\.0+$", "$1"), F.lit(""))


def number_key(c: Column) -> Column:
    """Text of a number in any notation: whole ones without a fraction, others as they are."""
    n = c.try_cast("decimal(38,9)")
    return F.when(n == F.floor(n), F.floor(n).cast("string")).otherwise(quantity_key(c))


def metadata_value(c: Column) -> Column:
    return F.nullif(squeeze(F.replace(F.lower(c), F.lit(","), F.lit("."))), F.lit(""))


def metadata_field(c: Column) -> Column:
    """The product field that a printed field name stands for; null if none."""
    return _lookup(_inverted(FIELDS), squeeze(F.replace(F.replace(F.lower(c), F.lit("."), F.lit("")), F.lit("_"), F.lit(" "))))


def ocr_text(c: Column) -> Column:
    """Key of read text: lower case, one diameter sign, points for commas, no blanks."""
    return F.regexp_replace(F.translate(F.lower(strip(c)), "ø#,", "ØØ."), r"(?U)\s+", "")


def is_numeric_candidate(c: Column) -> Column:
    return ~c.rlike("[a-wyzA-WYZ]") & c.rlike(r"(?U)\d")


def ocr_class(c: Column) -> Column:
    """Ratio before diameter before count."""
    return F.when(c.contains(":"), "ratio_or_scale_candidate").when(c.rlike("[øØ#]"), "diameter_candidate").when(c.rlike(r"(?iU)\(?x\d+\)?"), "quantity_candidate").otherwise("numeric_candidate")


def is_weak(c: Column) -> Column:
    return c.rlike(r"(?U)^\d$")


def comparison_keys(t: Column) -> Column:
    """The forms under which a normalised text may match: as it is, without diameter sign, without count, without both."""
    bare = F.regexp_replace(t, "[øØ#]", "")
    count = r"(?iU)^\(?x\d+\)?"
    more = F.array(bare, F.regexp_replace(t, count, ""), F.regexp_replace(bare, count, ""))
    return F.array_distinct(F.concat(F.array(t), F.filter(more, lambda v: v != "")))


def axis_positions(length: Column, tile: int = TILE, overlap: int = OVERLAP, least: int = MIN_EDGE) -> Column:
    """Starts of overlapping tiles along an edge, in closed form; the last moves back if its rest is short."""
    step = max(1, tile - overlap)
    k = F.ceil((length - tile) / F.lit(step)).cast("int")
    last = F.when(length - k * step >= least, k * step).otherwise(length - tile)
    return F.when(length <= tile, F.array(F.lit(0))).otherwise(F.concat(F.sequence(F.lit(0), (k - 1) * step, F.lit(step)), F.array(last)))


def clamp(v: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(v, high))


def crop_box(x: Column, y: Column, w: Column, h: Column, image_w: Column, image_h: Column) -> Column:
    """Struct of x, y, width, height around a box, padded and kept in bounds; null for boxes or images without size."""
    def side(start: Column, size: Column, limit: Column) -> tuple[Column, Column]:
        wide = F.least(F.least(F.greatest(size + 2 * CROP_PADDING, F.lit(CROP_MIN)), F.lit(CROP_MAX)), limit)
        return clamp(F.bround(start + size / 2 - wide / 2).cast("int"), F.lit(0), limit - wide), wide

    (cx, cw), (cy, ch) = side(x, w, image_w), side(y, h, image_h)
    box = F.struct(cx.cast("int").alias("x"), cy.cast("int").alias("y"), cw.cast("int").alias("width"), ch.cast("int").alias("height"))
    return F.when((w > 0) & (h > 0) & (image_w > 0) & (image_h > 0), box)


def polygon_box(points: Column) -> Column:
    """Struct of x, y, width, height around [[x, y], ...], cut towards zero."""
    low = lambda i: F.array_min(F.transform(points, lambda p: F.get(p, F.lit(i)))).cast("int")
    high = lambda i: F.array_max(F.transform(points, lambda p: F.get(p, F.lit(i)))).cast("int")
    box = F.struct(low(0).alias("x"), low(1).alias("y"), F.greatest(F.lit(0), high(0) - low(0)).alias("width"), F.greatest(F.lit(0), high(1) - low(1)).alias("height"))
    return F.when((F.size(points) > 0) & F.forall(points, lambda p: F.size(p) >= 2), box)


def overlap(a: str, b: str) -> Column:
    """Whether boxes (columns x, y, width, height under aliases a and b) share some area; touching is none."""
    c = lambda s, n: F.col(f"{s}.{n}")
    return (c(a, "x") < c(b, "x") + c(b, "width")) & (c(b, "x") < c(a, "x") + c(a, "width")) & (c(a, "y") < c(b, "y") + c(b, "height")) & (c(b, "y") < c(a, "y") + c(a, "height"))


def slug(c: Column) -> Column:
    parts = F.filter(F.split(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", "_")), "_"), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.array_join(parts, "_")).otherwise("drawing")


def output_slug(c: Column) -> Column:
    """The first two telling parts of a slug, or the whole slug if there is none."""
    telling = F.filter(F.split(slug(c), "_"), lambda p: ~p.isin(*SLUG_NOISE) & ~p.rlike(r"(?U)^\d+$"))
    return F.when(F.size(telling) > 0, F.array_join(F.slice(telling, 1, 2), "_")).otherwise(slug(c))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def is_supported(path: Column) -> Column:
    return extension(path).isin(*SUPPORTED)


def media_type(path: Column) -> Column:
    return F.coalesce(_lookup({"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp"}, extension(path)), F.lit("image/png"))


def fingerprint(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def png_size(content: Column) -> Column:
    """Struct of width, height from a PNG header; null for anything else."""
    word = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    return F.when((F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A") & (F.length(content) >= 24), F.struct(word(17).alias("width"), word(21).alias("height")))


def json_object(text: Column) -> Column:
    """From the first ``{`` to the last ``}``; null if there is none."""
    start = F.instr(text, "{")
    end = F.length(text) - F.instr(F.reverse(text), "}") + 1
    return F.when((start > 0) & (F.instr(text, "}") > 0) & (end >= start), F.substring(text, start, end - start + 1))


def is_scale_correction(product: Column, read: Column) -> Column:
    """Whether ``read`` only mends the punctuation of a scale."""
    digits = lambda c: F.regexp_replace(c, r"(?U)\D", "")
    return F.coalesce(read.contains(":") & product.rlike("[.,]") & ~product.contains(":") & (digits(read) == digits(product)), F.lit(False))
