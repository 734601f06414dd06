"""What has been processed already."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_process(files: DataFrame, registry: DataFrame, force: bool = False) -> DataFrame:
    """Files whose fingerprint has no completed entry; of equal files in one batch, the first by path.

    With ``force`` all files. An equal file comes up if the first one fails:
    see ``next_equal``.
    """
    if force:
        return files
    done = registry.filter("status = 'completed'").select("fingerprint").distinct()
    return _first(files).join(done, "fingerprint", "left_anti")


def _first(files: DataFrame) -> DataFrame:
    """Of equal files the first by path, case aside; one aggregation and no join."""
    row = F.struct(*[F.col(c) for c in files.columns])
    return files.groupBy("fingerprint").agg(F.min_by(row, F.struct(F.lower("path"), F.col("path"))).alias("_row")).select("_row.*")


def next_equal(files: DataFrame, results: DataFrame) -> DataFrame:
    """The next file by path of each fingerprint that has only failed in ``results`` (path, fingerprint, status) so far."""
    failed = results.groupBy("fingerprint").agg(F.bool_and(F.col("status") == "failed").alias("all")).filter("all").select("fingerprint")
    return _first(files.join(failed, "fingerprint", "left_semi").join(results.select("path"), "path", "left_anti"))


def due(files: DataFrame, registry: DataFrame, held: DataFrame, tries: int | None = None) -> DataFrame:
    """path, fingerprint, failures: all files that may be tried, new ones, failed ones and those held back for an equal one.

    ``held`` has path, fingerprint. Files with a completed entry of their
    fingerprint are not due, nor are those that have failed ``tries`` times.
    One aggregation by fingerprint: a row of a file's failures for each path.
    """
    fresh = files.select("path", "fingerprint").unionByName(held.select("path", "fingerprint")).select("path", "fingerprint", F.lit(0).alias("failures"))
    failed = registry.filter("status = 'failed'").select("path", "fingerprint", F.lit(1).alias("failures"))
    each = fresh.unionByName(failed).groupBy("fingerprint", "path").agg(F.sum("failures").alias("failures"))
    done = registry.filter("status = 'completed'").select("fingerprint").distinct()
    each = each.join(done, "fingerprint", "left_anti").select("path", "fingerprint", "failures")
    return each if tries is None else each.filter(F.col("failures") < tries)


def next_tries(due_: DataFrame) -> DataFrame:
    """path, fingerprint: of equal files the one with the fewest failures, the first by path of those, case aside."""
    return due_.groupBy("fingerprint").agg(F.min_by("path", F.struct("failures", F.lower("path"), F.col("path"))).alias("path")).select("path", "fingerprint")


def skip_messages(files: DataFrame, registry: DataFrame) -> DataFrame:
    """path, message for files that have a completed entry, with the result of the latest one where it is known."""
    last = latest_completed(registry)
    result = F.col("result_path") if "result_path" in registry.columns else F.lit(None).cast("string")
    known = last.select("fingerprint", result.alias("_result"))
    text = F.concat(F.lit("SKIP "), F.col("path"), F.lit(" (already completed)"), F.coalesce(F.concat(F.lit(" -> "), F.nullif(F.col("_result"), F.lit(""))), F.lit("")))
    return files.join(known, "fingerprint").select("path", text.alias("message"))


def failed_entries(failures: DataFrame) -> DataFrame:
    """Registry rows for rows of path, filename, fingerprint, error."""
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return failures.select(F.col("path").alias("input_path"), F.col("filename").alias("original_filename"), "fingerprint", F.lit("failed").alias("status"), "error", now.alias("processed_at"))


#: What orders the entries of a registry, the first column first; see ``entries``.
ORDER = ("batch", "seq")


def latest_completed(registry: DataFrame) -> DataFrame:
    """The last completed entry of each fingerprint, by batch and then seq (whichever of them there are); combined before any shuffle."""
    order = [F.col(c) for c in ORDER if c in registry.columns]
    row = F.struct(*[F.col(c) for c in registry.columns])
    return registry.filter("status = 'completed'").groupBy("fingerprint").agg(F.max_by(row, F.struct(*order)).alias("r")).select("r.*")


def status_counts(registry: DataFrame) -> DataFrame:
    return registry.agg(F.count("*").alias("entries"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"))


def entries(results: DataFrame, batch: int) -> DataFrame:
    """Rows to append for a batch of results: ``batch`` and, within it, ``seq``; the two together are the order of the registry.

    Rows are numbered without gathering them, in whatever partition they are.
    """
    return results.withColumn("batch", F.lit(batch).cast("long")).withColumn("seq", F.monotonically_increasing_id())
