"""How many rows go to a Python worker at a time."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def of_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of ``rows`` rows at most for jobs that start inside: rows that hold pictures or documents may be long."""
    before = spark.conf.get(SETTING)
    spark.conf.set(SETTING, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(SETTING, before)
