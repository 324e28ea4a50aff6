"""Ingest of arriving files: each micro-batch is parsed and appended, resumed from its checkpoint."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallylog.operators.stats import bucket_start
from tallylog.plans.schema import LOGS
from tallylog.sources import lines, parse
from tallylog.sources.storage import storage
from tallylog.streaming.progress import Throttle


def stream_files(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """Files as they arrive, a row each; their contents aren't read here."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).load(folder).select("path", F.xxhash64("path").alias("source_id"))


def ingest(spark: SparkSession, folder: str, profile: dict, out: str, checkpoint: str, files_per_batch: int = 16, progress: Callable[[dict], None] | None = None) -> StreamingQuery:
    """Parse all files that have arrived since the last run; a batch that is run again replaces itself.

    A batch knows its files by name only; they are then read like any others, in ranges and
    unpacked.  Its rows of all kinds are one write, and count once ``commits`` has the batch.
    ``progress`` is told the counts of each batch, observed as it is written, and of all so far.
    """
    told = Throttle(progress) if progress else None
    total = {"files": 0, "record": 0, "error": 0, "skipped": 0}
    own = storage(spark, out)

    def commit(batch: DataFrame, batch_id: int) -> None:
        # at most files_per_batch rows
        arrived = [(r["source_id"], unquote(re.sub("^file:/+", "/", r["path"]))) for r in batch.collect()]
        if not arrived:
            return
        seen = Observation()
        outcomes = parse.parse(lines.read_sources(spark, arrived, profile["strategy"]["kind"] == "w3c"), profile)
        flat = [f"record.{n}" for n in parse.RECORD_NAMES]
        rows = outcomes.select("source_id", "line_number", *flat, parse.extra_json(F.col("record.extra")).alias("extra_json"), "code", "field", "kind")
        rows = rows.observe(seen, *[F.count_if(F.col("kind") == k).alias(k) for k in ("record", "error", "skipped")])
        rows.write.mode("overwrite").partitionBy("kind").parquet(f"{own.url}/rows/batch={batch_id}")
        counts = {"batch": batch_id, "files": len(arrived), **seen.get}
        own.replace(f"commits/{batch_id:012d}.json", json.dumps(counts).encode())
        for name in total:
            total[name] += counts[name]
        if told:
            told(dict(total, batch=batch_id))

    query = stream_files(spark, folder, files_per_batch).writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    return query


def ingested(spark: SparkSession, out: str, kind: str = "record") -> DataFrame:
    """The rows of one kind of the committed batches."""
    own = storage(spark, out)
    names = {f.name: f.dataType.simpleString() for f in LOGS if f.name not in ("job_id", "batch_id")} | {"code": "string", "field": "string", "kind": "string", "batch": "bigint"}
    schema = ", ".join(f"{n} {t}" for n, t in names.items())
    paths = [f"{own.url}/rows/batch={int(n.removesuffix('.json'))}" for n in own.names("commits")]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.option("basePath", f"{own.url}/rows").schema(schema).parquet(*paths).where(F.col("kind") == kind)


def live_timeline(logs: DataFrame, seconds: int = 60, late: str = "60 seconds") -> DataFrame:
    """Counts by bucket over a stream of parsed logs; rows later than the watermark are left out."""
    start = F.timestamp_micros(bucket_start(F.col("timestamp_utc"), seconds))
    return logs.withWatermark("timestamp_utc", late).groupBy(F.window("timestamp_utc", f"{seconds} seconds").alias("w"), start.alias("bucket")).agg(F.count("*").alias("n"))
