"""Documents as files of their own, visible only when all of them are written.

Tasks write below a hidden folder; a second job moves the files to their
places once every one is there, and may be run again if it breaks off. No list
of files passes through the driver. Folders are reached as pyarrow reaches
them (a path, ``file://``, ``hdfs://``, ``s3://``...).
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import batches
from .json_text import compact

MANIFEST = "file string, bytes long"
FILES_A_BATCH = 64


def located(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root.removeprefix("file:"))


def winners(texts: DataFrame) -> DataFrame:
    """file, text: of rows of file, text and path that name the same file, the last by path, case aside."""
    last = F.max_by("text", F.struct(F.lower("path"), "path"))
    return texts.filter("file IS NOT NULL AND text IS NOT NULL").groupBy("file").agg(last.alias("text"))


def write(texts: DataFrame, root: str) -> int:
    """Write each row's text (UTF-8) or bytes to its ``file`` below ``root``, over what is there; the number of files.

    ``file`` is relative, and each one occurs once (see ``winners``). Nothing
    is visible before all files are written: a failure leaves ``root`` as it
    was. Rows with a null are left out.
    """
    spark = texts.sparkSession
    place, base = located(root)
    hidden = posixpath.join(base, f"_staged-{uuid.uuid4().hex}")

    def put(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to, _ = located(root)
        for pdf in parts:
            sizes = []
            for file, text in zip(pdf["file"], pdf["text"]):
                data = text.encode() if isinstance(text, str) else text
                target = posixpath.join(hidden, "files", file)
                to.create_dir(posixpath.dirname(target), recursive=True)
                with to.open_output_stream(target) as out:
                    out.write(data)
                sizes.append(len(data))
            yield pd.DataFrame({"file": pdf["file"], "bytes": sizes})

    def move(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to, _ = located(root)
        for pdf in parts:
            for file in pdf["file"]:
                source, target = posixpath.join(hidden, "files", file), posixpath.join(base, file)
                if to.get_file_info(source).type == fs.FileType.File:  # else an earlier try has moved it
                    to.create_dir(posixpath.dirname(target), recursive=True)
                    to.move(source, target)
            yield pdf[["file", "bytes"]]

    manifest = posixpath.join(root, posixpath.basename(hidden), "manifest")
    try:
        with batches.of_rows(spark, FILES_A_BATCH):
            texts.filter("file IS NOT NULL AND text IS NOT NULL").select("file", "text").mapInPandas(put, MANIFEST).write.parquet(manifest)
        return spark.read.schema(MANIFEST).parquet(manifest).mapInPandas(move, MANIFEST).agg(F.count("*")).first()[0]
    finally:
        if place.get_file_info(hidden).type == fs.FileType.Directory:
            place.delete_dir(hidden)


def _rows(table: dict) -> dict:
    """A table as it is printed: bare values below columns, with labels only where a row has one."""
    columns, rows = table.pop("columns", None), table.pop("rows")
    if columns is None:
        return table | {"rows": [{"label": r.get("label"), "cells": r["cells"]} for r in rows]}
    labelled = any(r.get("label") is not None for r in rows)
    return table | {"columns": columns, "rows": [{"label": r.get("label"), "values": r["values"]} if labelled else r["values"] for r in rows]}


@F.pandas_udf(StringType())
def product_json(text: pd.Series) -> pd.Series:
    """The JSON of a parsed product's row, laid out as its document."""
    def one(t: str | None) -> str | None:
        if t is None:
            return None
        x = json.loads(t)
        for n in ("tolerances", "notes"):
            x[n] = json.loads(x[n])
        for n in ("dimension_tables", "tables"):
            x[n] = [_rows(table) for table in x[n]]
        return compact(x) + "\n"

    return text.map(one)


@F.pandas_udf(StringType())
def indented_json(text: pd.Series) -> pd.Series:
    """JSON text with an indent of two and a newline at its end; texts of entries are put in as what they hold."""
    def opened(x):
        if isinstance(x, list):
            return [json.loads(i) if isinstance(i, str) and i.startswith("{") else opened(i) for i in x]
        return {k: opened(v) for k, v in x.items()} if isinstance(x, dict) else x

    return text.map(lambda t: None if t is None else json.dumps(opened(json.loads(t)), indent=2, ensure_ascii=False) + "\n")
