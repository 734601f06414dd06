"""``python -m sheetlake.command process PATH --responses FILE`` and ``... status``: batches of drawings as a Spark job."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .functions import paths
from .operators import chain, extract, registry
from .sources import files, outputs as documents, providers

LOCAL_URL, HOSTED_URL, HOSTED_KEY = "http://localhost:11434/api/generate", "https://api.anthropic.com/v1/messages", "ANTHROPIC_API_KEY"

REGISTRY = "path string, filename string, fingerprint string, status string, extraction_status string, result_path string, batch long, seq long"


def parser() -> argparse.ArgumentParser:
    given = config.read()
    top = argparse.ArgumentParser(prog="sheetlake")
    commands = top.add_subparsers(dest="command")
    process = commands.add_parser("process", help="read new drawings below a path")
    process.add_argument("input_path", nargs="?", default="inputs/incoming")
    process.add_argument("--responses", help="recorded model responses, JSON lines with file_name, raw_response and perhaps page, part_id, error, truncated")
    process.add_argument("--texts", help="recorded text blocks of a reader program, JSON lines with file_name, page, ordinal, polygon, text, confidence")
    process.add_argument("--documents", action="store_true", help="also write each document as a file below OUTPUTS/documents")
    process.add_argument("--force", action="store_true", help="also what has a completed entry")
    process.add_argument("--retry-failed", action="store_true", help="for compatibility; failed files come up again anyway")
    process.add_argument("--extractor", default=given.extractor, choices=config.EXTRACTORS, help="model endpoint to ask where no response is recorded")
    process.add_argument("--model", default=given.model)
    process.add_argument("--ollama-think", choices=["true", "false", "low", "medium", "high", "max"], help="thinking setting of a local model")
    process.add_argument("--generate-crops", action="store_true", help="also make overlapping tiles: their boxes and, of PNG pages, their pictures")
    process.add_argument("--extract-crops", action="store_true", help="also read the tiles: recorded responses, and calls for the others")
    process.add_argument("--ocr", action="store_true", help="use the text blocks of --texts (see the README)")
    process.add_argument("--ocr-engine", default="rapidocr")
    for p in (process, commands.add_parser("status", help="count the entries of the registry")):
        p.add_argument("--outputs", default="outputs")
    return top


def endpoint(extractor: str, model: str | None, think: str | None):
    """What asks the model; None without an extractor."""
    name = extract.resolved_model(extractor, model)
    if extractor == "ollama":
        return providers.local_generate(LOCAL_URL, name, config.think(think))
    if extractor == "anthropic":
        return providers.hosted_messages(HOSTED_URL, name, HOSTED_KEY)
    if extractor != "none":
        raise ValueError(f"unknown extractor: {extractor}")
    return None


def known(spark: SparkSession, outputs: str) -> DataFrame:
    """The registry below ``outputs``; empty before the first batch."""
    try:
        return spark.read.schema(REGISTRY).parquet(f"{outputs}/registry")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], REGISTRY)


def process(
    spark: SparkSession, input_path: str, outputs: str, responses: str | None = None, force: bool = False, ask: providers.Ask | None = None, crops: bool = False, *,
    extract_crops: bool = False, texts: str | None = None, extractor: str = "none", model: str | None = None, rendered: DataFrame | None = None, write_documents: bool = False, calls: dict | None = None,
) -> dict[str, int]:
    """Read what is new, append products, reviews, audits and registry entries, and return found, processed, skipped, failed.

    See ``operators.chain`` for the steps. Files without a recorded response
    are sent to ``ask`` (see ``sources.providers``) or, without it, get the
    default product and the extraction status not_run; those whose call gave
    no text are failed and come up again next time. Of equal files the first
    by path is tried, and the next one where it fails. The registry is written
    last and once: a batch that breaks off is done again under the same
    number, and calls that its ledger has are not made again.
    """
    entries = known(spark, outputs)
    number = batch_number(entries)
    work = f"{outputs}/work/batch={number}"
    files.discover(spark, input_path).write.mode("overwrite").parquet(f"{work}/files")  # contents are read and hashed once
    found = spark.read.parquet(f"{work}/files")
    recorded = files.recorded(spark, responses) if responses else None
    read = files.recorded_texts(spark, texts) if texts else None
    images = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(input_path).select(F.col("path").alias("image_path"), F.col("content").alias("image")) if ask else None
    todo, log, turn, counts = registry.to_process(found, entries, force), None, 0, {"processed": 0, "failed": 0}
    while True:
        x = chain.Inputs(todo, f"{work}/part={turn}", extractor, model, recorded, ask, images, rendered, read, crops, extract_crops, calls or {})
        x.files = x.write(todo, "todo")
        made = chain.run(x)
        products, mode = made["products"].withColumn("json", chain.product_text(made["products"])), "append" if turn else "overwrite"
        products.write.mode("overwrite").parquet(f"{outputs}/products/batch={number}/part={turn}")
        for name in ("reviews", "audits"):
            made[name].write.mode(mode).parquet(f"{outputs}/{name}/batch={number}")
        if made["tiles"] is not None:
            made["tiles"].drop("ord").write.mode(mode).parquet(f"{outputs}/tiles/batch={number}")
        if write_documents:
            documents.write(documents.winners(chain.texts(made)), f"{outputs}/documents")
        place = F.format_string(f"{outputs}/documents/products/%s.json" if write_documents else f"{outputs}/products/batch={number}#%s", paths.output_name(F.col("path")))
        done = made["products"].select("path", F.col("file_name").alias("filename"), "fingerprint", F.when(F.col("failed"), "failed").otherwise("completed").alias("status"), F.col("status").alias("extraction_status"), F.when(~F.col("failed"), place).alias("result_path"))
        n = done.agg(F.count_if(F.col("status") == "completed").alias("processed"), F.count_if(F.col("status") == "failed").alias("failed")).first()
        counts = {k: v + n[k] for k, v in counts.items()}
        log, turn = done if log is None else log.unionByName(done), turn + 1
        if force or n["failed"] == 0:
            break
        todo = registry.next_equal(found, log)
        if todo.isEmpty():
            break
    # in order of paths, so that of equal files that were all worked the last one is the latest entry
    registry.entries(log.orderBy(F.lower("path"), "path"), number).select(*[c.split()[0] for c in REGISTRY.split(", ")]).write.mode("append").parquet(f"{outputs}/registry")
    total = found.count()
    return {"found": total, "processed": counts["processed"], "skipped": total - counts["processed"] - counts["failed"], "failed": counts["failed"]}


def batch_number(entries: DataFrame) -> int:
    """One more than the last batch in the registry; all entries of a batch carry its number."""
    return entries.agg(F.coalesce(F.max(F.coalesce("batch", "seq")) + 1, F.lit(0))).first()[0]


def main(argv: Sequence[str] | None = None) -> int:
    """Exit status 1 if any file failed. Without a command, process."""
    config.load_env()
    args = parser().parse_args(argv)
    if args.command is None:
        args = parser().parse_args(["process"])
        args.extractor, args.model = "none", None
    spark = SparkSession.builder.appName("sheetlake").getOrCreate()
    if args.command == "status":
        counts = registry.status_counts(known(spark, args.outputs)).first().asDict()
    else:
        counts = process(
            spark, args.input_path, args.outputs, args.responses, args.force, endpoint(args.extractor, args.model, args.ollama_think), args.generate_crops, extract_crops=args.extract_crops,
            texts=args.texts if args.ocr else None, extractor=args.extractor, model=extract.resolved_model(args.extractor, args.model), write_documents=args.documents,
        )
    print("\n".join(f"{name}: {n}" for name, n in counts.items()))
    return int(args.command == "process" and counts["failed"] > 0)


if __name__ == "__main__":
    raise SystemExit(main())
