"""PDF files: the number and sizes of pages from their bytes, and pages through a renderer that is plugged in.

The cross-reference sections (tables, streams, or both) are followed from the
end of a file to its page tree. Nothing is drawn and no page's contents are
read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

PAGES = "path string, page int, width double, height double, png binary, error string"

#: Takes the bytes of a file and the dots per inch (0: sizes only) and gives (width, height, PNG or None) for each page.
Renderer = Callable[[bytes, int], list[tuple[float, float, bytes | None]]]

_GAP = re.compile(rb"(?:[\x00\t\n\x0c\r ]|%[^\r\n]*)*")
_WORD = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
_REFERENCE = re.compile(rb"(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![A-Za-z])")
_OBJECT = re.compile(rb"(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+obj")
MOST_DEEP, MOST_SECTIONS = 100, 10_000


class Broken(ValueError):
    """What a file lacks."""


class Ref(NamedTuple):
    number: int


def value(data: bytes, at: int, depth: int = 0):
    """The value that starts at ``at``, and where it ends. Names are texts, strings None, dictionaries and lists as such."""
    at = _GAP.match(data, at).end()
    head = data[at:at + 2]
    if depth > MOST_DEEP or not head:
        raise Broken("A value has no end or is nested too deeply.")
    if head == b"<<":
        out, at = {}, at + 2
        while not data.startswith(b">>", at := _GAP.match(data, at).end()):
            name, at = value(data, at, depth + 1)
            out[name if isinstance(name, str) else None], at = value(data, at, depth + 1)
        return out, at + 2
    if head[:1] == b"[":
        items, at = [], at + 1
        while data[(at := _GAP.match(data, at).end()):at + 1] != b"]":
            item, at = value(data, at, depth + 1)
            items.append(item)
        return items, at + 1
    if head[:1] == b"/":
        word = _WORD.match(data, at + 1)
        return (word.group().decode("latin-1") if word else ""), word.end() if word else at + 1
    if head[:1] == b"(":
        return None, _string_end(data, at)
    if head[:1] == b"<":
        return None, data.index(b">", at) + 1
    if ref := _REFERENCE.match(data, at):
        return Ref(int(ref[1])), ref.end()
    if not (word := _WORD.match(data, at)):
        raise Broken("A value cannot be read.")
    text = word.group()
    try:
        return (float(text) if b"." in text else int(text)), word.end()
    except ValueError:
        return {b"true": True, b"false": False}.get(text), word.end()


def _string_end(data: bytes, at: int) -> int:
    open_ = 0
    for mark in re.compile(rb"\\.|[()]", re.S).finditer(data, at):
        open_ += {b"(": 1, b")": -1}.get(mark.group(), 0)
        if not open_:
            return mark.end()
    raise Broken("A string has no end.")


class File:
    """The objects of a file by number: where each stands, or in which object stream."""

    def __init__(self, data: bytes) -> None:
        self.data, self.places, self.trailer, self.streams = data, {}, {}, {}
        last = data.rfind(b"startxref")
        found = re.compile(rb"startxref[\x00\t\n\x0c\r ]+(\d+)").match(data, last) if last >= 0 else None
        if not found:
            raise Broken("No cross-reference was found.")
        todo, seen = [int(found[1])], set()
        while todo:
            at = todo.pop(0)
            if at in seen or len(seen) > MOST_SECTIONS:
                continue
            seen.add(at)
            own = self._table(at) if data.startswith(b"xref", at := _GAP.match(data, at).end()) else self._stream(at)
            self.trailer = own | self.trailer  # the newest section counts
            todo += [own[n] for n in ("XRefStm", "Prev") if isinstance(own.get(n), int)]

    def _table(self, at: int) -> dict:
        line = re.compile(rb"[\x00\t\n\x0c\r ]*(\d+)[ ]+(\d+)(?:[ ]+([nf]))?")
        at += 4
        while (head := line.match(self.data, at)) and not head[3]:
            first, at = int(head[1]), head.end()
            for number in range(first, first + int(head[2])):
                entry = line.match(self.data, at)
                if not entry or not entry[3]:
                    raise Broken("A cross-reference table is cut off.")
                at = entry.end()
                if entry[3] == b"n":
                    self.places.setdefault(number, (int(entry[1]), None))
        at = _GAP.match(self.data, at).end()
        if not self.data.startswith(b"trailer", at):
            raise Broken("A cross-reference table has no trailer.")
        return value(self.data, at + 7)[0]

    def _stream(self, at: int) -> dict:
        own, body = self._object(at)
        if not isinstance(own, dict) or own.get("Type") != "XRef" or body is None:
            raise Broken("No cross-reference stands where it should.")
        widths = own["W"]
        index = own.get("Index") or [0, own["Size"]]
        size, at = sum(widths), 0
        for first, count in zip(index[::2], index[1::2]):
            for number in range(first, first + count):
                row, at = body[at:at + size], at + size
                if len(row) < size:
                    raise Broken("A cross-reference stream is cut off.")
                cut = [0, widths[0], widths[0] + widths[1], size]
                kind, a, b = (int.from_bytes(row[i:j], "big") for i, j in zip(cut, cut[1:]))
                kind = kind if widths[0] else 1
                if kind in (1, 2):
                    self.places.setdefault(number, (a, None) if kind == 1 else (a, b))
        return own

    def _object(self, at: int):
        """The value of the object at ``at``, and its stream's decoded bytes if it has one."""
        head = _OBJECT.match(self.data, _GAP.match(self.data, at).end())
        if not head:
            raise Broken("No object stands where it should.")
        own, end = value(self.data, head.end())
        mark = re.compile(rb"[\x00\t\n\x0c\r ]*stream\r?\n").match(self.data, end)
        if not isinstance(own, dict) or not mark:
            return own, None
        length = self.get(own.get("Length"))
        stop = mark.end() + length if isinstance(length, int) else self.data.find(b"endstream", mark.end())
        return own, self._decoded(own, self.data[mark.end():stop])

    def _decoded(self, own: dict, body: bytes) -> bytes | None:
        filters = own.get("Filter")
        filters = filters if isinstance(filters, list) else [filters] if filters else []
        if not filters:
            return body
        if filters != ["FlateDecode"]:
            return None
        body = zlib.decompressobj().decompress(body)
        how = own.get("DecodeParms")
        how = (how[0] if isinstance(how, list) and how else how) or {}
        if how.get("Predictor", 1) < 10:
            return body
        wide = how.get("Columns", 1)
        rows, before = [], bytes(wide)
        for i in range(0, len(body) - wide, wide + 1):
            kind, row = body[i], bytearray(body[i + 1:i + 1 + wide])
            if kind not in (0, 2):
                raise Broken("A stream has a row filter that is not read.")
            if kind == 2:
                row = bytearray((x + y) & 255 for x, y in zip(row, before))
            before = bytes(row)
            rows.append(before)
        return b"".join(rows)

    def get(self, x, depth: int = 0):
        """``x``, or what it refers to; None for objects that there are none of."""
        if not isinstance(x, Ref) or depth > MOST_DEEP:
            return None if isinstance(x, Ref) else x
        place = self.places.get(x.number)
        if place is None:
            return None
        if place[1] is None:
            return self.get(self._object(place[0])[0], depth + 1)
        if place[0] not in self.streams:
            where = self.places.get(place[0])
            if where is None or where[1] is not None:
                raise Broken("An object stream is missing.")
            own, body = self._object(where[0])
            if body is None:
                raise Broken("An object stream cannot be decoded.")
            numbers = body[:own["First"]].split()
            self.streams[place[0]] = {int(n): own["First"] + int(a) for n, a in zip(numbers[::2], numbers[1::2])}, body
        starts, body = self.streams[place[0]]
        return self.get(value(body, starts[x.number])[0], depth + 1) if x.number in starts else None

    def pages(self) -> list[tuple[float, float] | None]:
        """Width and height in points of each page, in order; None where a page has no box."""
        root = self.get(self.trailer.get("Root"))
        if not isinstance(root, dict):
            raise Broken("No catalogue was found.")
        out, seen, todo = [], set(), [(root.get("Pages"), None)]
        while todo:
            ref, box = todo.pop()
            if isinstance(ref, Ref):
                if ref in seen:
                    continue
                seen.add(ref)
            node = self.get(ref)
            if not isinstance(node, dict):
                continue
            box = self.get(node.get("MediaBox")) or box
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                todo += [(k, box) for k in reversed(kids)]
            else:
                sides = [self.get(v) for v in box] if isinstance(box, list) else []
                fine = len(sides) == 4 and all(isinstance(v, (int, float)) for v in sides)
                out.append((abs(float(sides[2] - sides[0])), abs(float(sides[3] - sides[1]))) if fine else None)
        if not out:
            raise Broken("No pages were found.")
        return out


_PAGE = StructType([StructField("width", DoubleType()), StructField("height", DoubleType())])
FACTS = StructType([StructField("page_count", IntegerType()), StructField("is_pdf", BooleanType()), StructField("pages", ArrayType(_PAGE)), StructField("note", StringType())])


def facts_of(content: bytes | None) -> tuple:
    """page_count, is_pdf, pages, note; what cannot be read has no count and a note that says why."""
    if content is None:
        return None, None, None, None
    is_pdf = b"%PDF-" in content[:1024]
    try:
        if not is_pdf:
            raise Broken("The file does not start as a PDF.")
        sizes = File(content).pages()
        return len(sizes), True, [{"width": s[0], "height": s[1]} if s else {"width": None, "height": None} for s in sizes], None
    except Broken as e:
        return None, is_pdf, None, str(e)
    except (ValueError, KeyError, IndexError, TypeError, AttributeError, RecursionError, zlib.error) as e:
        return None, is_pdf, None, f"The file is damaged ({type(e).__name__})."


@F.pandas_udf(FACTS)
def facts(content: pd.Series) -> pd.DataFrame:
    """``facts_of`` each file's bytes."""
    return pd.DataFrame([facts_of(None if c is None else bytes(c)) for c in content], columns=["page_count", "is_pdf", "pages", "note"]).astype({"page_count": "Int32", "is_pdf": "boolean"})


def pages(files: DataFrame, render: Renderer, dpi: int = 0, first_only: bool = False) -> DataFrame:
    """A row per page of rows of path and content; a file that cannot be read gives one row with its error.

    Sizes are in points without ``dpi`` and in pixels with it. Pages are made
    where the bytes are, one file at a time.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    made = render(bytes(content), dpi)[: 1 if first_only else None]
                    rows = [(path, i, float(w), float(h), png, None) for i, (w, h, png) in enumerate(made, 1)]
                except Exception as e:  # a broken file is a row, never a lost task
                    rows = [(path, None, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in PAGES.split(", ")]).astype({"page": "Int32"})

    return files.select("path", "content").mapInPandas(run, PAGES)
