"""A stream of files kept in step with the registry, a batch at a time."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import registry as R


def workspace(spark) -> str:
    """A new folder below the one that all executors share; a temporary one on a single machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    return f"{(named or 'file://' + tempfile.gettempdir()).rstrip('/')}/sheetlake-{uuid.uuid4().hex}"


ENTRIES = "path string, fingerprint string, status string, batch long, seq long"
HELD = "path string, fingerprint string, batch long"


def _table(spark, path: str, schema: str) -> DataFrame:
    """The rows written so far; none before the first batch."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def process_batches(files: DataFrame, registry_path: str, work: Callable[[DataFrame], DataFrame], checkpoint: str, tries: int | None = None):
    """Start a query that runs ``work`` on what is due and appends to the registry.

    ``files`` is a stream of path, fingerprint; ``work`` returns path,
    fingerprint, status for such rows. Of equal files one is tried in a
    batch. If it fails, the others are held back (in a table beside the
    registry) and come up in the following batches, those with the fewest
    failures first; a file that has failed comes up again as well, until its
    fingerprint is completed or it has failed ``tries`` times (None: no end).
    A batch that is run again after a failure tries only what has no entry of
    that batch yet.
    """
    held_path = f"{registry_path}-held"

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        entries, held = _table(spark, registry_path, ENTRIES), _table(spark, held_path, HELD)
        before = F.col("batch") < number
        ready = R.due(df, entries.filter(before), held.filter(before), tries)
        tried = entries.filter(F.col("batch") == number).select("fingerprint").distinct()
        done = work(R.next_tries(ready).join(tried, "fingerprint", "left_anti"))
        R.entries(done, number).select("path", "fingerprint", "status", "batch", "seq").write.mode("append").parquet(registry_path)
        made = _table(spark, registry_path, ENTRIES).filter(F.col("batch") == number)
        failed = made.filter("status = 'failed'").select("fingerprint").distinct()
        # earlier ones are in a table already: as held files or as failed entries
        known = held.select("path", "fingerprint").unionByName(made.select("path", "fingerprint"))
        new = df.select("path", "fingerprint").distinct().join(failed, "fingerprint", "left_semi").join(known, ["path", "fingerprint"], "left_anti")
        new.withColumn("batch", F.lit(number).cast("long")).write.mode("append").parquet(held_path)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
