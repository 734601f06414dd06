"""Files as DataFrames, and what their headers tell."""

from __future__ import annotations

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import exprs as X
from . import pdf


LISTED = "path string, modificationTime timestamp, length long, content binary"


def discover(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """path, filename, extension, size_bytes and, with ``content``, fingerprint, image size and PDF facts of the supported files below ``path``.

    Empty if there are none or the path does not exist.
    """
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        files = spark.createDataFrame([], LISTED)
    name = F.element_at(F.split("path", "/"), -1)
    files = files.filter(X.is_supported(F.col("path"))).withColumn("extension", X.extension(F.col("path")))
    told = pdf.facts(F.when(F.col("extension") == "pdf", F.col("content")))
    pdf_facts = F.when(F.col("extension") == "pdf", told)
    facts = (X.fingerprint(F.col("content")).alias("fingerprint"), image_size(F.col("content"), F.col("extension")).alias("image"), pdf_facts.alias("pdf"))
    return files.select("path", name.alias("filename"), "extension", F.col("length").alias("size_bytes"), *(facts if content else ()))


#: Markers of a JPEG's frame headers, and those that stand alone.
FRAMES = (0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF)
ALONE = (0xD8, 0xD9)


def _jpeg(content: bytes | None):
    """Width and height from the first frame header of a JPEG stream; bytes between segments are passed over."""
    if not content or content[:2] != b"\xff\xd8":
        return None
    at = 2
    while (at := content.find(b"\xff", at)) >= 0:
        head = content[at:].lstrip(b"\xff")[:8] if content[at:at + 2] == b"\xff\xff" else content[at + 1:at + 9]
        at = content.index(head[:1], at + 1) if head else len(content)
        if head and head[0] in ALONE:
            at += 1
            continue
        if len(head) < 3 or (size := int.from_bytes(head[1:3], "big")) < 2:
            return None
        if head[0] in FRAMES:
            return {"height": int.from_bytes(head[4:6], "big"), "width": int.from_bytes(head[6:8], "big")} if len(head) == 8 else None
        at += 1 + size
    return None


_SIZE = StructType([StructField("width", IntegerType()), StructField("height", IntegerType())])


@F.pandas_udf(_SIZE)
def jpeg_size(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_jpeg(c) or {"width": None, "height": None} for c in content], columns=["width", "height"]).astype("Int32")


def image_size(content, extension=None):
    """Struct of width and height; null where the header is not found. Python sees JPEG contents only.

    With ``extension`` only the kind of header that it stands for is read.
    """
    is_ = lambda *names: F.lit(True) if extension is None else extension.isin(*names)
    jpeg = jpeg_size(F.when(is_("jpg", "jpeg") & (F.hex(F.substring(content, 1, 2)) == "FFD8"), content))
    return F.coalesce(F.when(is_("png"), X.png_size(content)), F.when(jpeg["width"].isNotNull(), jpeg))


def recorded(spark: SparkSession, path: str) -> DataFrame:
    """Recorded responses, one JSON object a line: file_name, page (1 where absent), part_id (of a tile or target; else null), raw_response, error, truncated."""
    schema = "file_name string, page int, part_id string, raw_response string, error string, truncated boolean"
    return spark.read.schema(schema).json(path).withColumns({"page": F.coalesce("page", F.lit(1)), "truncated": F.coalesce("truncated", F.lit(False))})


def recorded_texts(spark: SparkSession, path: str) -> DataFrame:
    """Recorded text blocks of a reader program, one JSON object a line, as ``operators.ocr.blocks`` takes them, with file_name."""
    schema = "file_name string, page int, ordinal int, polygon array<array<double>>, text string, confidence double, engine string, elapsed double, source_ref string"
    return spark.read.schema(schema).json(path).withColumn("page", F.coalesce("page", F.lit(1)))
