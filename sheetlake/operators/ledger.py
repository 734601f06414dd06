"""A ledger of paid calls: what is recorded is never asked again.

Calls are made in waves of a bounded number of requests. Each wave is a job of
its own whose answers are appended to the ledger when it ends, so a batch that
breaks off, for a lost executor or any other reason, loses the wave it was in
at most. When it is done again, only requests without an entry are asked.
"""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import batches, providers

CALLS = f"key string, {providers.SCHEMA}"
WAVE = 2000
#: Requests, with their pictures, that a worker holds at a time.
REQUESTS_A_BATCH = 64


def key(*parts: str) -> Column:
    """What makes a request the same one: its id, its prompt, its file's fingerprint, the model."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]), 256)


def calls(spark: SparkSession, place: str) -> DataFrame:
    """The ledger at ``place``; empty before the first call."""
    try:
        return spark.read.schema(CALLS).parquet(place)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CALLS)


def answered(requests: DataFrame, images: DataFrame, ask: providers.Ask, place: str, work: str, *, wave: int = WAVE, **how) -> DataFrame:
    """Answers (``providers.SCHEMA``) to all ``requests``, of which only those without an entry at ``place`` are asked.

    ``requests`` has key, request_id, prompt and image_path; ``images``
    image_path and image. Requests without an image get no answer. ``work`` is
    a new folder that all executors share: the open requests are written there
    with their images, a folder for each wave, so that no wave reads another
    one's. ``how`` goes to ``providers.respond``.
    """
    spark = requests.sparkSession
    open_ = requests.join(calls(spark, place).select("key"), "key", "left_anti")
    n = open_.count()
    waves = max(1, math.ceil(n / wave))
    if n:
        dealt = open_.withColumn("wave", F.pmod(F.xxhash64("key"), F.lit(waves)).cast("int")).join(images.select("image_path", "image"), "image_path")
        dealt.write.partitionBy("wave").parquet(work)
        staged = spark.read.parquet(work)
    for i in range(waves if n else 0):
        mine = staged.filter(F.col("wave") == i)
        keys = mine.select("key", "request_id")
        got = providers.respond(mine.select(F.col("key").alias("request_id"), "prompt", "image", "image_path"), ask, **how)
        with batches.of_rows(spark, REQUESTS_A_BATCH):
            got.withColumnRenamed("request_id", "key").join(keys, "key").select("key", "request_id", "status", "raw_response", "error", "truncated").write.mode("append").parquet(place)
    return calls(spark, place).drop("request_id").join(requests.select("key", "request_id"), "key").select("request_id", "status", "raw_response", "error", "truncated")
