"""What the operators of this subpackage share: tables, the shared folder, cut lineage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: rows of two numbers that a broadcast may hold: 32 MB
BROADCAST_ROWS = 1 << 21


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local one of its own only where all is one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="tallylog-")
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/tallylog-{kind}-{uuid.uuid4().hex}"


def file_store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path in the shared folder, for Python code, and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(path if urlparse(path).scheme else f"file://{path}")


def materialise(df: DataFrame, kind: str = "table") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage like ``checkpoint()`` does, survives lost executors, and is stored by
    column and compressed.
    """
    spark = df.sparkSession
    path = new_path(spark, kind)
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.tallylog_path = path
    return found


def discard(*frames: DataFrame) -> None:
    """Delete the tables that ``materialise`` wrote for ``frames``, which nothing reads any more."""
    for df in frames:
        path = getattr(df, "tallylog_path", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a materialised table of a few numbers a row, to be broadcast if it has at most ``rows`` rows; else the planner joins it by its keys."""
    return F.broadcast(df) if df.count() <= rows else df


#: keys that are joined apart because many rows have them, at most
HEAVY_KEYS = 1000


def by_heavy_keys(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each ``key`` and tells by ``weight`` how many of ``rows`` have it.

    The keys of more than a thousandth of all rows, at most HEAVY_KEYS, are broadcast; of the
    others none has many rows, and they are joined by their keys.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    heavy = F.col(weight) * HEAVY_KEYS > total
    named = table.withColumnRenamed(key, "_of")
    few = rows.join(F.broadcast(named.where(heavy)), rows[key] == F.col("_of"), "left")
    others = [c for c in table.columns if c != key]
    rest = few.where("_of is null").select(rows.columns).join(named.where(~heavy), rows[key] == F.col("_of"))
    return few.where("_of is not null").select(*rows.columns, *others).unionByName(rest.select(*rows.columns, *others))


def batches(pieces: list[bytes], limit: int = 1 << 19) -> list[slice]:
    """Runs of pieces of about ``limit`` bytes each."""
    found, first, size = [], 0, 0
    for k, piece in enumerate(pieces):
        if size and size + len(piece) > limit:
            found.append(slice(first, k))
            first, size = k, 0
        size += len(piece)
    return [*found, slice(first, len(pieces))] if pieces else []


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Names for more columns of ``df`` that none of its own has, in any case."""
    held = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while (own := f"_{name}").lower() in held:
            name = own
        held.add(own.lower())
        found.append(own)
    return found


#: what empties the caches that a task leaves in its Python worker, which Spark keeps for other tasks
CACHES: list[Callable[[], None]] = []


#: gives memory that was freed back to the system, where the C library can
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Memory that was freed goes back to the system; what is kept stays."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def let_go() -> None:
    """Called where a task of another kind begins: forget what the worker's earlier tasks kept, and give back their memory."""
    for clear in CACHES:
        clear()
    give_back()


def text_bytes(df: DataFrame, name: str) -> F.Column:
    """Column ``name`` as UTF-8 bytes, null as empty."""
    return F.coalesce(df[name].cast("binary"), F.lit(b""))
