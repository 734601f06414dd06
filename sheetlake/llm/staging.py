"""Tables written to the folder that all executors share, to cut lineage between phases."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}

#: What a row takes in a broadcast table besides its values.
ROW_BYTES = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where it is unset and the master is local (tests on one machine), a
    temporary folder of this process is used, one for each application. On a
    cluster a shared folder is needed.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="sheetlake-")
    return _OWN[app]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and return a reader of it.

    The files survive the loss of any executor; a failed task is simply run
    again, and what follows does not repeat the work before it.
    """
    return stage_at(df, name)[0]


def stage_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``stage``, and where the table is."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sheetlake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a staged table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def small_side(df: DataFrame, rows: int, most_bytes: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if it has ``rows`` rows at most; else as it is, for a join by shuffling.

    With ``most_bytes``, which is for rows of no fixed length, they must also
    come to that size at most: the length of a row's JSON and ROW_BYTES more.
    """
    few = df.limit(rows + 1)
    if most_bytes is None:
        return F.broadcast(df) if few.count() <= rows else df
    size = F.octet_length(F.to_json(F.struct(*df.columns))) + ROW_BYTES
    n, total = few.agg(F.count("*"), F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= most_bytes else df
