"""Failed files and those held back for an equal one come up again; against a plain loop."""

import random

from pyspark.sql import functions as F
from sheetlake.operators import registry as R
from sheetlake.streaming import incremental


def plain(batches, fails, tries):
    """The entries of each batch, one file after the other."""
    seen, failures, completed, out = {}, {}, set(), []
    for files in batches:
        for path, print_ in files:
            seen.setdefault(print_, set()).add(path)
        entries = []
        for print_, paths in seen.items():
            ready = [p for p in paths if tries is None or failures.get((p, print_), 0) < tries]
            if print_ in completed or not ready:
                continue
            path = min(ready, key=lambda p: (failures.get((p, print_), 0), p.lower(), p))
            failed = failures.get((path, print_), 0) < fails[path]
            failures[path, print_] = failures.get((path, print_), 0) + failed
            completed |= set() if failed else {print_}
            entries.append((path, print_, "failed" if failed else "completed"))
        out.append(sorted(entries))
    return out


def stream(spark, place, batches, fails, tries):
    """The same as a stream: each batch's files arrive and are worked off."""
    out, registry = [], f"{place}/registry"
    need = F.create_map(*[F.lit(x) for pair in fails.items() for x in pair])

    def work(df):
        before = incremental._table(spark, registry, incremental.ENTRIES).filter("status = 'failed'").groupBy("path", "fingerprint").agg(F.count("*").alias("n"))
        rows = df.join(before, ["path", "fingerprint"], "left")
        return rows.select("path", "fingerprint", F.when(F.coalesce("n", F.lit(0)) < need[F.col("path")], "failed").otherwise("completed").alias("status"))

    for i, files in enumerate(batches):
        spark.createDataFrame(files, "path string, fingerprint string").coalesce(1).write.mode("append").parquet(f"{place}/files")
        source = spark.readStream.schema("path string, fingerprint string").parquet(f"{place}/files")
        incremental.process_batches(source, registry, work, f"{place}/progress", tries).awaitTermination()
        out.append(sorted(tuple(r) for r in spark.read.parquet(registry).filter(F.col("batch") == i).select("path", "fingerprint", "status").collect()))
    return out


def test_a_failed_file_and_its_equals_come_up_later(spark, tmp_path):
    batches = [[("a1", "A"), ("a2", "A"), ("B", "B"), ("c", "C"), ("c", "C")], [("d", "D")], [("e", "E"), ("a3", "A")]]
    fails = {"a1": 9, "a2": 0, "a3": 0, "B": 1, "c": 0, "d": 0, "e": 0}
    got = stream(spark, tmp_path, batches, fails, None)
    assert got == [[("B", "B", "failed"), ("a1", "A", "failed"), ("c", "C", "completed")], [("B", "B", "completed"), ("a2", "A", "completed"), ("d", "D", "completed")], [("e", "E", "completed")]]


def test_as_a_plain_loop(spark, tmp_path):
    rng = random.Random(5)
    names = [f"{rng.choice('xX')}{i}" for i in range(24)]
    fails = {n: rng.choice([0, 0, 1, 2, 9]) for n in names}
    batches = [[(n, "ABCDEFGH"[i % 8]) for i, n in enumerate(names) if i % 4 == b] + [(f"z{b}", f"Z{b}")] for b in range(4)]
    fails |= {f"z{b}": 0 for b in range(4)}
    assert stream(spark, tmp_path, batches, fails, 2) == plain(batches, fails, 2)


def test_due_without_any_rows(spark):
    files = spark.createDataFrame([], "path string, fingerprint string")
    entries = spark.createDataFrame([], incremental.ENTRIES)
    assert R.next_tries(R.due(files, entries, files)).count() == 0
    one = spark.createDataFrame([("p", "f")], "path string, fingerprint string")
    failed = spark.createDataFrame([("p", "f", "failed", 0, 0)] * 2, incremental.ENTRIES)
    assert [tuple(r) for r in R.due(one, failed, one).collect()] == [("p", "f", 2)] and R.due(one, failed, one, 2).count() == 0


def test_a_batch_that_is_run_again_adds_nothing(spark, tmp_path):
    batches, fails = [[("a1", "A"), ("a2", "A"), ("b", "B")]], {"a1": 1, "a2": 0, "b": 0}
    first = stream(spark, tmp_path, batches, fails, None)
    for name in ("0", ".0.crc"):
        (tmp_path / "progress/commits" / name).unlink()  # the driver was lost before the batch was marked as done
    source = spark.readStream.schema("path string, fingerprint string").parquet(f"{tmp_path}/files")
    asked = str(tmp_path / "asked")

    def work(df):
        df.write.parquet(asked)
        return df.withColumn("status", F.lit("completed"))

    incremental.process_batches(source, f"{tmp_path}/registry", work, f"{tmp_path}/progress").awaitTermination()
    assert spark.read.parquet(asked).count() == 0
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/registry").select("path", "fingerprint", "status").collect()) == first[0]
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/registry-held").collect()] == [("a2", "A", 0)]
