"""Log files: finding them, reading numbered lines, telling their format."""

from __future__ import annotations

import gzip
import hashlib
import io
import os
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import BinaryIO
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallylog.plans.schema import DETECT_LINES, SAMPLE_BYTES, SAMPLE_LINES, SCAN_ENTRIES
from tallylog.sources import parse, ranges, storage
from tallylog.sources.formats import definition_hash, preset

#: fixed values: formats that detection tries, in order of preference
CANDIDATES = ("combined", "common", "w3c")
HEAD_BYTES, PREVIEW_BYTES = 64 << 10, 1 << 20
GZIP = b"\x1f\x8b"
#: rows of the table of blocks that a broadcast may hold: about 24 MB
BROADCAST_BLOCKS = 1 << 20


@dataclass
class Scan:
    files: list[str] = field(default_factory=list)
    errors: list[tuple[str, str]] = field(default_factory=list)
    truncated: bool = False


def wildcard(pattern: str) -> re.Pattern[str]:
    """``*`` and ``?`` over a whole name, in its case."""
    return re.compile("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern), re.DOTALL)


def scan(root: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), max_depth: int | None = None, follow_links: bool = False, limit: int = SCAN_ENTRIES, spark: SparkSession | None = None) -> Scan:
    """Files below ``root`` by name patterns, exclusion first; what can't be read is listed.  With ``spark``, ``root`` may be on any Hadoop file system."""
    found, seen = Scan(), 0
    wanted, refused = [wildcard(p) for p in include], [wildcard(p) for p in exclude]
    takes = lambda name: not any(p.fullmatch(name) for p in refused) and (not wanted or any(p.fullmatch(name) for p in wanted))
    if spark is not None:
        own = storage.mounted(spark, root)
        if own is None:
            paths = storage.listed(spark, root, max_depth)
            found.truncated = len(paths) > limit
            found.files = [p for p in paths[:limit] if takes(p.rsplit("/", 1)[1])]
            return found
        root = own
    base = root.rstrip("/").count("/")
    for folder, folders, names in os.walk(root, onerror=lambda e: found.errors.append((e.filename, e.strerror)), followlinks=follow_links):
        if max_depth is not None and folder.count("/") - base >= max_depth:
            folders.clear()
        for name in names:
            seen += 1
            if seen > limit:
                found.truncated = True
                found.files.sort()
                return found
            path = f"{folder}/{name}"
            if takes(name) and (follow_links or not os.path.islink(path)):
                found.files.append(path)
    found.files.sort()
    return found


def is_gzip(spark: SparkSession, path: str) -> bool:
    """By the first two bytes; the name doesn't count."""
    return storage.head(spark, path, 2)[0] == GZIP


def identity(spark: SparkSession, path: str, whole: bool = False) -> dict[str, object]:
    """What tells a source apart: its size and the digest of its first 64 KiB, or of all of it."""
    data, size, changed = storage.head(spark, path, HEAD_BYTES)
    found: dict[str, object] = {"file_size": size, "head_hash": hashlib.sha256(data).hexdigest(), "head_bytes": len(data), "full_hash": None}
    if whole:
        # in the cluster where Python can't open it; binaryFile holds a file of 2 GB at most
        own = storage.mounted(spark, path)
        if own is None:
            found["full_hash"] = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
        else:
            with open(own, "rb") as f:
                found["full_hash"] = hashlib.file_digest(f, "sha256").hexdigest()
    return found | {"modified_unix": int(changed), "compression": "gzip" if data[:2] == GZIP else "none"}


def identities_of(spark: SparkSession, paths: list[str]) -> list[dict[str, object]]:
    """``identity`` of many files, several at a time."""
    with ThreadPoolExecutor(32) as pool:
        return list(pool.map(lambda p: identity(spark, p), paths))


def identities(spark: SparkSession, path: str) -> DataFrame:
    """Size and head digest of many files, in the cluster."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("file_size"), F.sha2(F.substring("content", 1, HEAD_BYTES), 256).alias("head_hash"), F.unix_seconds("modificationTime").alias("modified_unix"))


def sizes(spark: SparkSession, sources: list[tuple[int, str]]) -> list[ranges.Span]:
    """One span for each source that Python can open, over all of its bytes."""
    found = []
    for source_id, path in sources:
        data, size, _ = storage.head(spark, path, 2)
        if size:
            found.append(ranges.Span(source_id, storage.mounted(spark, path), data == GZIP, 0, 0, 0, size))
    return found


def _blocks(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(_file, _block, _at, value): lines of files that only Spark's readers open, in blocks of the same bytes in every scan.

    A session of its own holds the settings by which blocks are cut: an opened file counts as
    a whole block, so neither cores nor other files change the size, and each task has one.
    """
    own = spark.newSession()
    for key in ("maxPartitionBytes", "openCostInBytes"):
        own.conf.set(f"spark.sql.files.{key}", str(ranges.SPAN_MOST))
    raw = own.read.option("lineSep", "\n").text(paths)
    return raw.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"), F.spark_partition_id().alias("_task"), "value")


def _key(path: str) -> str:
    """A path as it is told apart from others, without its percent codes."""
    return re.sub("^([a-z0-9]+):/+", r"\1:/", unquote(path))


def read_remote(spark: SparkSession, sources: list[tuple[int, str]]) -> tuple[DataFrame, dict[int, int]]:
    """(source_id, line_number, value) of text files on file systems that Python can't open, and the number of lines of each source.

    Spark unpacks files with the suffix of their compression.  A line's number is its place in
    its block and the lines of the blocks before it, which are counted first.
    """
    for _, path in sources:
        if not path.endswith(".gz") and storage.head(spark, path, 2)[0] == GZIP:
            raise ValueError("packed files need the suffix .gz on this file system")
    raw = _blocks(spark, [p for _, p in sources])
    counted = raw.groupBy("_file", "_block", "_task").agg(F.count("*").alias("n")).collect()
    if len({r["_task"] for r in counted}) != len(counted):
        raise ValueError("blocks aren't read by tasks of their own")
    of, before, table = {_key(storage.qualified(spark, p)): i for i, p in sources}, {i: 0 for i, _ in sources}, []
    for row in sorted(counted, key=lambda r: (r["_file"], r["_block"])):
        source = of[_key(row["_file"])]
        table.append((row["_file"], row["_block"], source, before[source] + 1))
        before[source] += row["n"]
    first = spark.createDataFrame(table, "_file string, _block long, source_id long, _first long")
    lines = raw.join(F.broadcast(first) if len(table) <= BROADCAST_BLOCKS else first, ["_file", "_block"])
    return lines.select("source_id", (F.col("_first") + F.col("_at")).alias("line_number"), "value"), before


def read_spans(spark: SparkSession, spans: list[ranges.Span], headers: bool = False, size: int | None = None) -> DataFrame:
    """(source_id, line_number, value, start_offset, next_offset, header) of numbered spans."""
    found = ranges.lines_of(spark, spans, headers, size or ranges.span_bytes(spark, sum(s.high - s.low for s in spans)))
    return found.select("source_id", "line_number", F.col("bytes").cast("string").alias("value"), "start_offset", "next_offset", "header")


def read_counted(spark: SparkSession, sources: list[tuple[int, str]], headers: bool = False) -> tuple[DataFrame, dict[int, int]]:
    """(source_id, line_number, value) of all files, whatever they are compressed with and called, and the number of lines of each source; ``headers``: with ``header``, the W3C columns that hold at each line."""
    local = [(i, p) for i, p in sources if storage.mounted(spark, p) is not None]
    remote = [s for s in sources if s not in local]
    found, counts = None, {i: 0 for i, _ in sources}
    if local or not remote:
        whole = sizes(spark, local)
        size = ranges.span_bytes(spark, sum(s.high for s in whole))
        spans = ranges.counted(spark, ranges.cut(whole, size), {}, headers, size)
        for s in spans:
            counts[s.source_id] += s.lines
        found = read_spans(spark, spans, headers, size).select("source_id", "line_number", "value", *(["header"] if headers else []))
    if remote:
        more, own = read_remote(spark, remote)
        counts |= own
        more = parse.with_headers(more) if headers else more
        found = more if found is None else found.unionByName(more)
    return found, counts


def read_sources(spark: SparkSession, sources: list[tuple[int, str]], headers: bool = False) -> DataFrame:
    return read_counted(spark, sources, headers)[0]


def read_heads(spark: SparkSession, sources: list[tuple[int, str]], size: int = PREVIEW_BYTES) -> DataFrame:
    """The numbered lines within the first ``size`` bytes of each file, unpacked; a last line that is cut goes, unless it is the only one.

    A task reads the beginning of its files, so a look at large files costs no scan of them;
    of files that only Hadoop opens, the driver reads the beginnings, several at a time.
    """
    opened = [(i, storage.mounted(spark, p), None) for i, p in sources]
    far = [(i, p) for (i, p), (_, own, _) in zip(sources, opened, strict=True) if own is None]
    if far:
        with ThreadPoolExecutor(32) as pool:
            heads = dict(zip([i for i, _ in far], pool.map(lambda x: storage.head(spark, x[1], size + 1)[0], far), strict=True))
        opened = [(i, own, bytearray(heads[i]) if own is None else None) for i, own, _ in opened]
    names = spark.createDataFrame(opened, "source_id long, path string, head binary").repartition(max(1, min(len(sources), 1024)), "source_id")

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for source, path, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                stream = io.BytesIO(held) if path is None else open(path, "rb")
                packed = stream.read(2) == GZIP
                stream.seek(0)
                with gzip.GzipFile(fileobj=stream) if packed else stream as unpacked:
                    data = _begin(unpacked, size + 1)
                part = data[:size].removeprefix(b"\xef\xbb\xbf").split(b"\n")
                if len(part) > 1 and (len(data) > size or not part[-1]):
                    part.pop()
                if part != [b""]:
                    yield pa.RecordBatch.from_arrays([pa.array([source] * len(part), pa.int64()), pa.array(range(1, 1 + len(part)), pa.int64()), pa.array(part, pa.binary())], names=["source_id", "line_number", "bytes"])

    return names.mapInArrow(each, "source_id long, line_number long, bytes binary").select("source_id", "line_number", F.col("bytes").cast("string").alias("value"))


def _begin(stream: BinaryIO, size: int) -> bytes:
    """The first bytes of a stream, as far as it can be read; the beginning of a packed file ends within a member."""
    data = b""
    try:
        while len(data) < size and (more := stream.read1(size - len(data)) if hasattr(stream, "read1") else stream.read(size - len(data))):
            data += more
    except EOFError:
        pass
    return data


def preview(lines: DataFrame, profile: dict, rows: int = DETECT_LINES) -> tuple[DataFrame, DataFrame]:
    """Outcomes of the first lines, and how many of them match."""
    outcomes = parse.parse(lines.where(F.col("line_number") <= rows), profile)
    return outcomes, parse.match_rate(outcomes)


def sample(lines: DataFrame, rows: int = SAMPLE_LINES) -> DataFrame:
    """A few raw lines; null where they aren't valid text or too long to show."""
    few = lines.orderBy("source_id", "line_number").limit(min(rows, SAMPLE_LINES))
    return few.select("source_id", "line_number", F.when(F.is_valid_utf8("value") & (F.octet_length("value") <= SAMPLE_BYTES), F.col("value")).alias("value"))


def detect(lines: DataFrame, candidates: tuple[str, ...] = CANDIDATES, rows: int = DETECT_LINES) -> DataFrame:
    """(source_id, candidate, records, errors, skipped, match_rate): the best format of each source that has one."""
    first = lines.where(F.col("line_number") <= rows)
    tried = None
    for k, name in enumerate(candidates):
        rate = parse.match_rate(parse.parse(first, preset(name))).withColumns({"candidate": F.lit(name), "_k": F.lit(k)})
        tried = rate if tried is None else tried.unionByName(rate)
    best = Window.partitionBy("source_id").orderBy(F.desc("match_rate"), F.desc("records"), "_k")
    return tried.where("records > 0").withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank", "_k")


def grouped(detected: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources by the hash of their format's definition, and those that have none."""
    hashes = detected.sparkSession.createDataFrame([(c, definition_hash(preset(c))) for c in CANDIDATES], "candidate string, definition_hash string")
    named = detected.join(hashes, "candidate").join(sources, "source_id")
    return named.groupBy("definition_hash", "candidate").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("path")).alias("paths")), sources.join(detected, "source_id", "left_anti")


def majority(detected: DataFrame) -> DataFrame:
    return detected.groupBy("candidate").count().orderBy(F.desc("count"), "candidate").limit(1)
