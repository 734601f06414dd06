"""Pictures of tiles and targets, cut out of their pages."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..sources import outputs, png

CROP = "image_path string, id string, crop binary, error string"

#: Boxes of a page that one row holds on average; a page with more is read once for each part of them.
BOXES_A_ROW = 1024
#: Bytes of crops that go back together, unless one has more.
BATCH = 1 << 23


def cut(boxes: DataFrame, images: DataFrame | None = None, boxes_a_row: int = BOXES_A_ROW) -> DataFrame:
    """image_path, id, crop, error: a PNG for each row of ``boxes``, or why there is none.

    ``boxes`` has image_path, id, x, y, width and height; other columns are
    ignored, and rows that occur twice give two rows. Pages are read by their
    path, a piece at a time, or taken from ``images`` (image_path, image),
    where each path occurs once. Crops have the page's samples, palette and
    resolution. There is no crop of pages that are missing, damaged,
    interlaced or no PNG, and of boxes with a null or not inside the page.
    """
    number = [F.col(c).cast("long").alias(c) for c in ("x", "y", "width", "height")]
    rows = boxes.select("image_path", F.col("id").cast("string").alias("id"), *number)
    parts = rows.groupBy(F.col("image_path").alias("of")).agg(F.ceil(F.count("*") / F.lit(boxes_a_row)).alias("parts"))
    box = F.struct("id", "x", "y", "width", "height")
    spread = rows.join(parts, F.col("image_path").eqNullSafe(F.col("of"))).select("image_path", box.alias("box"), F.pmod(F.xxhash64(box), F.col("parts")).alias("part"))
    asked = spread.groupBy("image_path", "part").agg(F.collect_list("box").alias("boxes"))
    image = F.lit(None).cast("binary").alias("image")
    if images is None:
        asked = asked.select("image_path", "boxes", F.lit(True).alias("by_path"), image)
    else:
        asked = asked.join(images.select("image_path", "image"), "image_path", "left").select("image_path", "boxes", F.lit(False).alias("by_path"), "image")
    return asked.mapInArrow(_cut, CROP)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("image_path", pa.string()), ("id", pa.string()), ("crop", pa.binary()), ("error", pa.string())])
    done, size = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            path, boxes, by_path, image = (batch.column(c)[i].as_py() for c in range(4))
            for name, crop, error in _one(path, boxes, by_path, image):
                done.append({"image_path": path, "id": name, "crop": crop, "error": error})
                size += len(crop or b"") + 64
                if size > BATCH:
                    yield pa.RecordBatch.from_pylist(done, schema)
                    done, size = [], 0
    if done:
        yield pa.RecordBatch.from_pylist(done, schema)


def _one(path: str | None, boxes: list[dict], by_path: bool, image: bytes | None):
    whole = [png.Box(**b) for b in boxes if None not in (b["x"], b["y"], b["width"], b["height"])]
    yield from [(b["id"], None, "box with a null") for b in boxes if None in (b["x"], b["y"], b["width"], b["height"])]
    if path is None or (image is None and not by_path):
        yield from [(b.id, None, "no image") for b in whole]
    elif image is not None:
        yield from png.cut(io.BytesIO(image), whole)
    else:
        files, name = outputs.located(path)
        try:
            stream = files.open_input_stream(name, compression=None, buffer_size=png.PIECE)
        except FileNotFoundError:
            yield from [(b.id, None, "no image") for b in whole]
            return
        with stream:
            yield from png.cut(stream, whole)


@F.pandas_udf(BinaryType())
def samples(content: pd.Series) -> pd.Series:
    """The bytes of a PNG's rows, one after the other; null where it cannot be read."""
    return content.map(lambda c: None if c is None else png.samples(io.BytesIO(c)))
