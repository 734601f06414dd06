"""Untrusted model responses to typed products and refinements. Rows are never dropped; trouble goes to ``warnings``.

``sources.answers`` decodes a response once, into typed columns; all rules are
expressions over those. A leaf (kind and text) becomes a VARIANT, so that
numbers, booleans and whatever else an answer holds keep their type.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..sources import answers

SCALARS = answers.SCALARS
LISTS = ("dimensions", "dimension_tables", "tables", "schematics", "tolerances", "notes", "warnings")

#: The types of a product's lists, for empty ones.
ROWS = "array<struct<label:variant,cells:array<struct<column:variant,value:variant>>,values:array<variant>>>"
EMPTY = {
    "dimensions": "array<struct<raw_text:variant,value:variant,unit:variant,type:string,quantity:variant,label:variant,context:variant>>",
    "dimension_tables": f"array<struct<title:variant,context:variant,columns:array<string>,rows:{ROWS}>>",
    "tables": f"array<struct<type:string,title:variant,context:variant,columns:array<string>,rows:{ROWS}>>",
    "schematics": "array<struct<title:variant,context:variant,components:array<string>,parameters:array<struct<label:variant,value:variant,context:variant>>>>",
}

# What the warnings say, with {} for what is filled in.
NO_JSON, NO_OBJECT = "Extractor response was not valid JSON: {}", "Extractor response JSON was not an object."
REFINEMENT_NO_JSON, REFINEMENT_NO_OBJECT = "Refinement response was not valid JSON: {}", "Refinement response JSON was not an object."
PLACEHOLDER = "Semantic extraction is not implemented yet."
MOVED = "Moved sheet size value from `scale` to `size`."
FILE_LIKE = "`{}` may contain a source filename or file extension: `{}`."
NO_LIST = "`{}` was not a list and was reset."
DIMENSION_SKIPPED = "Dimension {} was not an object and was skipped."
DIMENSION_TYPE = "Dimension {} type `{}` is not allowed and was set to unknown."
SUSPICIOUS = "Suspicious diameter symbol in raw_text: `{}`."
ITEM_SKIPPED = "{} item {} was not an object and was skipped."
ROWS_RESET = "{} item {} rows were not a list and were reset."
ROW_SKIPPED = "{} item {} row {} was not an object and was skipped."
ROW_RESET = "{} item {} row {} had no cells or values and was reset."
PARAMETERS_RESET = "schematics item {} parameters was not a list and was reset."
PARAMETER_SKIPPED = "schematics item {} parameter {} was not an object and was skipped."
NO_CLASS = "Refinement classification was missing and was set to uncertain."
BAD_CLASS = "Refinement classification `{}` is not allowed and was set to uncertain."
WARNINGS_RESET = "Refinement warnings were not a list and were reset."
NO_CONFIDENCE = "Refinement confidence was missing and was set to 0.0."
BAD_CONTEXT = "Refinement local_context `{}` is not allowed and was set to unknown."
DIMENSION_RESET = "Refinement dimension was not an object and was reset."
METADATA_RESET = "Refinement metadata was not an object and was reset."

_product, _refinement, _table = (answers.decoder(s) for s in (answers.PRODUCT, answers.REFINEMENT, answers.TABLE))


def none() -> Column:
    return F.array().cast("array<string>")


def say(text: str, *parts: Column | str) -> Column:
    """A warning with its places filled in."""
    pieces = text.split("{}")
    filled = [F.lit(pieces[0])]
    for part, piece in zip(parts, pieces[1:]):
        filled += [part if isinstance(part, Column) else F.lit(part), F.lit(piece)]
    return F.concat(*filled)


def warn(*pairs: tuple[Column, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), m) for c, m in pairs]))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` written and made once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text(z: Column) -> Column:
    """The text of a leaf; null for other kinds."""
    return F.when(z["k"] == "text", z["t"])


def variant(z: Column) -> Column:
    """A leaf as VARIANT."""
    return F.when(z["k"] == "text", z["t"].cast("variant")).when(z["k"] == "float", z["t"].cast("double").cast("variant")).when(z["k"].isNotNull(), F.try_parse_json(z["t"]))


def text_of(v: Column) -> Column:
    """The text of a VARIANT that is one; null for other kinds."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def number(i: Column) -> Column:
    return (i + 1).cast("string")


def _same(a: Column, b: Column) -> Column:
    return F.coalesce(F.lower(a) == F.lower(b), F.lit(False))


def _label(d: Column) -> Column:
    """A dimension's label, unless it only repeats the text or the value."""
    again = _same(text(d["label"]), text(d["raw_text"])) | _same(text(d["label"]), text(d["value"]))
    return F.when(~again, d["label"])


def dimension(d: Column) -> Column:
    unit = F.when(d["unit"]["k"] == "text", X.unit(d["unit"]["t"]).cast("variant")).otherwise(variant(d["unit"]))
    return F.struct(
        variant(d["raw_text"]).alias("raw_text"), variant(d["value"]).alias("value"), unit.alias("unit"), X.dimension_type(text(d["type"])).alias("type"), variant(d["quantity"]).alias("quantity"),
        once(_label(d), variant).alias("label"), variant(d["context"]).alias("context"),
    )


def dimension_warnings(items: Column) -> Column:
    """Warnings for entries, numbered from 1: no object, a type that is none, a sign that may be a diameter's."""
    def own(d: Column, i: Column) -> Column:
        raw, type_ = text(d["raw_text"]), text(d["type"])

        def of(kind: Column) -> Column:
            bad = type_.isNotNull() & (kind == "unknown") & (F.replace(F.lower(type_), F.lit(" "), F.lit("_")) != "unknown")
            round_ = (kind == "diameter") | F.lower(F.concat_ws(" ", once(_label(d), text), text(d["context"]))).contains("diameter")
            return warn((bad, say(DIMENSION_TYPE, number(i), type_)), (raw.contains("#") & round_, say(SUSPICIOUS, raw)))

        return F.when(~d["object"], F.array(say(DIMENSION_SKIPPED, number(i)))).otherwise(once(X.dimension_type(type_), of))

    return F.flatten(F.transform(items, own))


def cells(row: Column, columns: Column) -> Column:
    """{column, value} leaves of a row: its cells, or its values set against the columns."""
    values = row["values"]["items"]
    names = F.when(row["labelled"] & (F.size(columns) == F.size(values) + 1), F.slice(columns, F.lit(2), F.greatest(F.size(columns), F.lit(1)))).otherwise(columns)
    zipped = once(names, lambda n: F.transform(values, lambda v, i: F.struct(F.get(n, i).alias("column"), v.alias("value"))))
    own = F.transform(row["cells"]["items"], lambda c: F.struct(c["column"].alias("column"), c["value"].alias("value")))
    return F.when(row["cells"]["k"] == "list", own).when(row["values"]["k"] == "list", zipped).otherwise(F.slice(own, 1, 0))


def redundant(label: Column, value: Column, column: Column) -> Column:
    """Whether a label only repeats the first value, perhaps after part of the first column's name. All are texts or null."""
    read = F.struct(F.lower(X.strip(label)).alias("low"), F.lower(X.strip(value)).alias("value"), F.lower(X.strip(column)).alias("column"))

    def repeats(z: Column) -> Column:
        rest = X.strip(F.substring(z["low"], F.lit(1), F.length(z["low"]) - F.length(z["value"])))
        return F.coalesce((F.length(z["value"]) > 0) & F.endswith(z["low"], z["value"]) & ((rest == "") | F.coalesce((z["column"] != "") & z["column"].contains(rest), F.lit(False))), F.lit(False))

    return F.when(label.isNull() | value.isNull(), F.lit(False)).otherwise(once(read, repeats))


def table(t: Column, typed: bool = True) -> Column:
    """Rows with cells; where all rows (two at least) have the same columns, ``columns`` and values instead.

    Columns that are no texts do not count, so that values move up to the
    next name.
    """
    def row(r: Column, names: Column) -> Column:
        def shown(c: Column) -> Column:
            first = F.get(c, F.lit(0))
            return F.struct(F.when(~redundant(text(r["label"]), text(first["value"]), text(first["column"])), r["label"]).alias("label"), c.alias("cells"))
        return once(cells(r, names), shown)

    def head(rows: Column) -> Column:
        """The columns that all rows have; null if there are none such."""
        heads = F.array_distinct(F.transform(rows, lambda r: F.transform(r["cells"], lambda c: text(c["column"]))))
        fit = lambda h: F.when((F.size(h) == 1) & (F.size(F.get(h, F.lit(0))) > 0) & ~F.exists(F.get(h, F.lit(0)), lambda c: c.isNull()), F.get(h, F.lit(0)))
        return F.when(F.size(rows) >= 2, once(heads, fit))

    def shown(rows: Column, columns: Column) -> Column:
        one = columns.isNotNull()
        pair = lambda c: F.struct(variant(c["column"]).alias("column"), variant(c["value"]).alias("value"))
        return F.transform(rows, lambda r: F.struct(variant(r["label"]).alias("label"), F.when(~one, F.transform(r["cells"], pair)).alias("cells"), F.when(one, F.transform(r["cells"], lambda c: variant(c["value"]))).alias("values")))

    made = F.transform(F.filter(t["rows"]["items"], lambda r: r["object"]), lambda r: row(r, t["columns"]["items"]))
    fields = [variant(t["title"]).alias("title"), variant(t["context"]).alias("context")]
    fields = [X.table_type(text(t["type"])).alias("type"), *fields] if typed else fields
    whole = lambda rows, columns: F.struct(*fields, columns.alias("columns"), shown(rows, columns).alias("rows"))
    return once(made, lambda rows: once(F.struct(head(rows).alias("h")), lambda z: whole(rows, z["h"])))


def tables(df: DataFrame, json_column: str, name: str = "t") -> DataFrame:
    """``df`` with ``name``, the table that a JSON text holds; null for a text that is none."""
    read = df.withColumn("_read", _table(F.col(json_column)))
    return read.withColumn(name, _table_column(df.sparkSession.sparkContext.applicationId)).drop("_read")


@cache
def _table_column(application: str) -> Column:
    return F.when(F.col("_read.v.object"), table(F.col("_read.v")))


def table_warnings(items: Column, name: str) -> Column:
    def own(t: Column, i: Column) -> Column:
        def rows(r: Column, j: Column) -> Column:
            bare = (F.coalesce(r["cells"]["k"], F.lit("")) != "list") & (F.coalesce(r["values"]["k"], F.lit("")) != "list")
            return F.when(~r["object"], say(ROW_SKIPPED, name, number(i), number(j))).when(bare, say(ROW_RESET, name, number(i), number(j)))
        unlisted = F.coalesce(t["rows"]["k"], F.lit("")) != "list"
        return F.when(~t["object"], F.array(say(ITEM_SKIPPED, name, number(i)))).when(unlisted, F.array(say(ROWS_RESET, name, number(i)))).otherwise(F.array_compact(F.transform(t["rows"]["items"], rows)))

    return F.flatten(F.transform(items, own))


def schematic(s: Column) -> Column:
    parameters = F.transform(F.filter(s["parameters"]["items"], lambda p: p["object"]), lambda p: F.struct(*[variant(p[n]).alias(n) for n in ("label", "value", "context")]))
    components = F.array_compact(F.transform(s["components"]["items"], text))
    return F.struct(variant(s["title"]).alias("title"), variant(s["context"]).alias("context"), components.alias("components"), parameters.alias("parameters"))


def schematic_warnings(items: Column) -> Column:
    def own(s: Column, i: Column) -> Column:
        lines = F.array_compact(F.transform(s["parameters"]["items"], lambda p, j: F.when(~p["object"], say(PARAMETER_SKIPPED, number(i), number(j)))))
        reset = s["parameters"]["k"] == "other"
        return F.when(~s["object"], F.array(say(ITEM_SKIPPED, "schematics", number(i)))).when(reset, F.array(say(PARAMETERS_RESET, number(i)))).otherwise(lines)

    return F.flatten(F.transform(items, own))


def _decoded(responses: DataFrame, keep: tuple[str, ...], decode, also: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` with ``error`` and ``v``, the decoded response."""
    more = [c for c in also if c not in keep]
    read = responses.select(*keep, *more, decode(F.col("raw_response")).alias("_read"))
    return read.select(*keep, *more, F.col("_read.error").alias("_error"), F.col("_read.v").alias("_v"))


def products(responses: DataFrame, keep: tuple[str, ...] = ("file_name",), found: str | None = None) -> DataFrame:
    """The columns ``keep`` with the product's fields and ``status`` for rows of file_name and raw_response.

    ``status`` is completed or validation_failed. Null, broken and non-object
    responses give the default product with a warning. The nine scalar fields
    and the leaves of lists are VARIANT; tolerances and notes are JSON text,
    and own warnings that are no texts are given as JSON. ``found`` names a
    column for the warnings of this parse alone, without those that the
    response has itself.
    """
    df = _decoded(responses, keep, _product, ("file_name",))
    told, own, fields = _product_columns(responses.sparkSession.sparkContext.applicationId)
    # warnings are made once, below what uses them three times
    return df.withColumns({"_told": told, "_own": own}).select(
        *keep, F.col("file_name").alias("source_file"), *fields,
        F.concat("_own", "_told").alias("warnings"), F.when(F.size("_told") > 0, "validation_failed").otherwise("completed").alias("status"),
        *([F.col("_told").alias(found)] if found else []),
    )


@cache
def _product_columns(application: str) -> tuple[Column, Column, list[Column]]:
    """Warnings, own warnings and fields over ``_v``, ``_error`` and ``file_name``; made once for each application, as that takes longer than using them."""
    v, ok = F.col("_v"), F.coalesce(F.col("_v.object"), F.lit(False))
    size, scale = v["size"], v["scale"]
    moved = size["k"].isNull() & X.is_sheet_size(text(scale))
    stem = F.regexp_replace("file_name", r"(?<=.)\.[^.]*$", "")
    checks = []
    for n in ("product_name", "document_name", "drawing_number"):
        t = text(v[n])
        checks.append((t.contains(".") | _same(t, F.col("file_name")) | _same(t, stem), say(FILE_LIKE, n, t)))
    resets = [(v[n]["k"] != "list", say(NO_LIST, n)) for n in LISTS]
    held = lambda n: v[n]["items"]
    told = F.concat(
        warn((moved, F.lit(MOVED)), *checks, *resets), dimension_warnings(held("dimensions")), table_warnings(held("dimension_tables"), "dimension_tables"), table_warnings(held("tables"), "tables"),
        schematic_warnings(held("schematics")),
    )
    told = F.when(ok, told).when(F.col("_error").isNotNull(), F.array(say(NO_JSON, F.col("_error")))).otherwise(F.array(F.lit(NO_OBJECT)))
    own = F.when(~ok, none()).when(v["warnings"]["k"].isNull(), F.array(F.lit(PLACEHOLDER))).otherwise(F.transform(held("warnings"), lambda w: w["t"]))
    entries = lambda n, f: F.transform(F.filter(held(n), lambda x: x["object"]), f)
    made = {"dimensions": entries("dimensions", dimension), "dimension_tables": entries("dimension_tables", lambda t: table(t, typed=False)), "tables": entries("tables", lambda t: table(t)), "schematics": entries("schematics", schematic)}
    return told, own, [
        *[variant(v[n]).alias(n) for n in SCALARS[:7]], once(F.when(moved, scale).otherwise(size), variant).alias("size"), once(F.when(~moved, scale), variant).alias("scale"),
        *[F.coalesce(c, F.array().cast(EMPTY[n])).alias(n) for n, c in made.items()], *[F.coalesce(v[n]["t"], F.lit("[]")).alias(n) for n in ("tolerances", "notes")],
    ]


def refinements(responses: DataFrame, keep: tuple[str, ...] = ("target_id",), found: str | None = None) -> DataFrame:
    """The columns ``keep`` with a refinement's fields, warnings and status for rows of raw_response.

    Fields that an answer lacks are defaults without a warning; null ones and
    those of a wrong kind warn. Texts that are other values are their JSON; a
    confidence that is a boolean is null. ``found`` as in ``products``.
    """
    df = _decoded(responses, keep, _refinement)
    v, ok = F.col("_v"), F.coalesce(F.col("_v.object"), F.lit(False))
    boolean = lambda n: F.when(v[n]["k"] == "boolean", v[n]["t"] == "true")
    class_, context = F.lower(X.strip(text(v["classification"]))), F.replace(F.lower(X.strip(text(v["local_context"]))), F.lit(" "), F.lit("_"))
    bad = lambda n: ~v[n]["object"] & (v[f"{n}_kind"]["k"] != "null") & v[f"{n}_kind"]["k"].isNotNull()
    number_ = v["confidence"]["k"].isin("whole", "float", "boolean")
    told = F.concat(
        warn(
            (v["classification"]["k"] != "text", F.lit(NO_CLASS)), (~class_.isin(*X.CLASSES), say(BAD_CLASS, v["classification"]["t"])), (v["warnings"]["k"] != "list", F.lit(WARNINGS_RESET)),
            (~number_, F.lit(NO_CONFIDENCE)), (~context.isin(*X.CONTEXTS), say(BAD_CONTEXT, v["local_context"]["t"])),
        ),
        F.when(v["dimension"]["object"], dimension_warnings(F.array(v["dimension"]))).otherwise(none()), warn((bad("dimension"), F.lit(DIMENSION_RESET)), (bad("metadata"), F.lit(METADATA_RESET))),
    )
    told = F.when(ok, told).when(F.col("_error").isNotNull(), F.array(say(REFINEMENT_NO_JSON, F.col("_error")))).otherwise(F.array(F.lit(REFINEMENT_NO_OBJECT)))
    own = F.coalesce(F.transform(v["warnings"]["items"], lambda w: w["t"]), none())
    read = df.withColumns({"_told": told, "_own": own})
    metadata = F.struct(v["metadata"]["field"]["t"].alias("field"), v["metadata"]["value"]["t"].alias("value"))
    confidence = F.when(v["confidence"].isNull() | ~number_, F.lit(0.0)).when(v["confidence"]["k"] != "boolean", v["confidence"]["t"].cast("double"))
    return read.select(
        *keep, F.when(class_.isin(*X.CLASSES), class_).otherwise("uncertain").alias("classification"), boolean("is_product_dimension").alias("is_product_dimension"),
        *[v[n]["t"].alias(n) for n in ("raw_text", "visual_text", "visible_label")], boolean("ocr_text_supported").alias("ocr_text_supported"),
        F.when(context.isin(*X.CONTEXTS), context).otherwise("unknown").alias("local_context"), F.when(v["dimension"]["object"], dimension(v["dimension"])).alias("dimension"),
        F.when(v["metadata"]["object"], metadata).alias("metadata"), confidence.alias("confidence"),
        F.concat("_own", "_told").alias("warnings"), F.when(F.size("_told") > 0, "validation_failed").otherwise("completed").alias("status"),
        *([F.col("_told").alias(found)] if found else []),
    )
