"""Untrusted answers of models, decoded strictly into typed columns.

Spark's JSON readers stop after the first value, refuse repeated keys and
cannot say what is wrong. Here a text is one JSON value or an error, as the
JSON module has it: the last of repeated keys counts, NaN and numbers of any
size are numbers. What comes out is not judged yet: a leaf is its kind and its
text, a list says whether it was one, an entry whether it was an object.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, StringType, StructField, StructType

from ..functions.exprs import MISREAD, NULL_WORDS

#: Fixed value: the error for a text without an object.
NOTHING = "No JSON object found."
ABSENT = ...  # the same object in every process
SKIPPED = NotImplemented  # a value in a place that is null as a whole; one object too

#: A decoder of a column of values, and the type of what it gives.
Spec = tuple[Callable[[list], pa.Array], pa.DataType]
TEXT = pa.string()
LEAF = pa.struct([("k", TEXT), ("t", TEXT)])
NO_LEAF = (None, None)


def _utf8(text: str) -> str:
    """Without halves of surrogate pairs, which no column can hold."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode()


def _dumps(x) -> str:
    return _utf8(json.dumps(x, ensure_ascii=False, separators=(",", ":")))


def _value(x):
    """Kind and text of any value; null has a kind too."""
    if x is ABSENT:
        return None
    if isinstance(x, str):
        return "text", _utf8(x)
    if isinstance(x, bool):
        return "boolean", "true" if x else "false"
    if isinstance(x, (int, float)):
        return ("float" if isinstance(x, float) else "whole"), repr(x)
    return ("null" if x is None else "json"), _dumps(x)


def _leaf(x):
    """As ``_value`` with texts mended and trimmed; null, absent ones and placeholder words are none."""
    if x is None or x is ABSENT:
        return None
    if isinstance(x, str):
        x = x.replace(*MISREAD).strip()
        return None if x.lower() in NULL_WORDS else ("text", _utf8(x))
    return _value(x)


def _struct(kind: pa.StructType, columns: list[pa.Array], nulls: list[bool]) -> pa.Array:
    return pa.StructArray.from_arrays(columns, fields=list(kind), mask=pa.array(nulls, pa.bool_()))


def _leaves(one: Callable) -> Spec:
    """Columns of kinds and texts, by a function of a single value."""
    def take(values: list) -> pa.Array:
        if all(x is ABSENT or x is SKIPPED for x in values):
            return pa.nulls(len(values), LEAF)
        read = [NO_LEAF if x is ABSENT or x is SKIPPED else one(x) or NO_LEAF for x in values]
        kinds, texts = zip(*read)
        return _struct(LEAF, [pa.array(kinds, TEXT), pa.array(texts, TEXT)], [k is None for k in kinds])

    return take, LEAF


raw: Spec = _leaves(_value)
leaf: Spec = _leaves(_leaf)
given: Spec = (lambda values: pa.array([None if x is SKIPPED else x is not None and x is not ABSENT for x in values], pa.bool_()), pa.bool_())


def entry(**fields: tuple[str, Spec] | Spec) -> Spec:
    """An object with some of its members; ``object`` is false for anything else. A member may have another name than its column."""
    parts = [(name, *(f if isinstance(f[0], str) else (name, f))) for name, f in fields.items()]
    kind = pa.struct([("object", pa.bool_()), *[(column, f[1]) for column, _, f in parts]])

    def take(values: list) -> pa.Array:
        objects = [isinstance(x, dict) for x in values]
        members = [f[0]([x.get(name, ABSENT) if o else SKIPPED for x, o in zip(values, objects)]) for _, name, f in parts]
        return _struct(kind, [pa.array(objects, pa.bool_()), *members], [x is SKIPPED for x in values])

    return take, kind


def listed(item: Spec, keep: Callable | None = None) -> Spec:
    """A list of items with its kind (list, null, other; none if absent); items that ``keep`` refuses are left out."""
    kind = pa.struct([("k", TEXT), ("items", pa.list_(item[1]))])

    def take(values: list) -> pa.Array:
        kinds, ends, flat = [], [0], []
        for x in values:
            if isinstance(x, list):
                kinds.append("list")
                flat += x if keep is None else [i for i in x if keep(i)]
            else:
                kinds.append(None if x is ABSENT or x is SKIPPED else "null" if x is None else "other")
            ends.append(len(flat))
        items = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), item[0](flat))
        return _struct(kind, [pa.array(kinds, TEXT), items], [x is SKIPPED for x in values])

    return take, kind


def _list_text(x):
    return ("list", _dumps(x)) if isinstance(x, list) else ("null" if x is None else "other", "[]")


list_text: Spec = _leaves(_list_text)


def body(text: str) -> str:
    """From the first ``{`` to the last ``}``, inside a fence if the text is one."""
    text = text.strip()
    if text.startswith("```"):
        lines = text.splitlines()[1:]
        text = "\n".join(lines[:-1] if lines and lines[-1].strip() == "```" else lines)
    start, end = text.find("{"), text.rfind("}")
    if start < 0 or end < start:
        raise ValueError(NOTHING)
    return text[start:end + 1]


def _spark(kind: pa.DataType) -> DataType:
    if pa.types.is_struct(kind):
        return StructType([StructField(f.name, _spark(f.type)) for f in kind])
    if pa.types.is_list(kind):
        return ArrayType(_spark(kind.value_type))
    return BooleanType() if pa.types.is_boolean(kind) else StringType()


def decoder(spec: Spec):
    """A function of a text column: error, and the decoded object where there is none."""
    take, kind = spec
    out = pa.struct([("error", TEXT), ("v", kind)])

    def tried(f: Callable, x):
        """An error's text, and what ``f`` makes of ``x``."""
        try:
            return None, f(x)
        except ValueError as e:
            return _utf8(str(e)), SKIPPED
        except RecursionError:
            return "nested too deeply", SKIPPED

    def columns(texts: list[str | None]) -> pa.Array:
        read = [tried(lambda t: json.loads(body(t or "")), t) for t in texts]
        why, values = tried(take, [v for _, v in read])
        if why is not None:  # some value cannot be told in text: each has its own error
            read = [(e, v) if e is not None else (why, v if (why := tried(take, [v])[0]) is None else SKIPPED) for e, v in read]
            values = take([v for _, v in read])
        return pa.StructArray.from_arrays([pa.array([e for e, _ in read], TEXT), values], fields=list(out))

    @F.arrow_udf(_spark(out))
    def decode(texts: pa.Array) -> pa.Array:
        # equal texts are read once
        read = texts.dictionary_encode()
        return columns(read.dictionary.to_pylist()).take(read.indices) if read.null_count == 0 else columns(texts.to_pylist())

    return decode


is_text = lambda x: isinstance(x, str)
is_object = lambda x: isinstance(x, dict)
SCALARS = ("brand_name", "product_name", "document_name", "drawing_number", "revision", "revision_date", "sheet", "size", "scale")
DIMENSION = entry(raw_text=leaf, value=leaf, unit=leaf, type=leaf, quantity=leaf, label=leaf, context=leaf)
ROW = entry(label=leaf, labelled=("label", given), cells=listed(entry(column=leaf, value=leaf), is_object), values=listed(leaf))
TABLE = entry(type=leaf, title=leaf, context=leaf, columns=listed(leaf, is_text), rows=listed(ROW))
SCHEMATIC = entry(title=leaf, context=leaf, components=listed(leaf, is_text), parameters=listed(entry(label=leaf, value=leaf, context=leaf)))
PRODUCT = entry(
    **{n: leaf for n in SCALARS}, dimensions=listed(DIMENSION), dimension_tables=listed(TABLE), tables=listed(TABLE), schematics=listed(SCHEMATIC), tolerances=list_text, notes=list_text, warnings=listed(raw),
)
REFINEMENT = entry(
    classification=raw, is_product_dimension=raw, raw_text=leaf, visual_text=leaf, ocr_text_supported=raw, local_context=raw, visible_label=leaf, dimension=DIMENSION, dimension_kind=("dimension", raw),
    metadata=entry(field=leaf, value=leaf), metadata_kind=("metadata", raw), confidence=raw, warnings=listed(raw),
)
