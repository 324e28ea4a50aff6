"""Stable pages over log rows by key, never by offset, and the detail of one row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylog.operators.filters import FilterError, LogFilter, apply_filter, frozen
from tallylog.plans.schema import PAGE_BYTES, PAGE_ROWS

COLUMNS = ("job_id", "source_id", "line_number", "timestamp_utc", "client_ip", "method", "request_target", "status", "bytes_sent", "extra_json", "bookmarked")
_TEXTS = ("client_ip", "method", "request_target", "extra_json")


@dataclass(frozen=True)
class Cursor:
    digest: str
    descending: bool
    max_batch: int | None
    #: key of the last row: time in microseconds (None among rows without a time), source, line
    time: int | None
    source_id: int
    line_number: int


@dataclass
class Page:
    rows: list
    cursor: Cursor | None


def page_order(descending: bool) -> list[Column]:
    """Time one way or the other, rows without a time last, then source and line upwards."""
    time = F.col("timestamp_utc")
    return [time.desc_nulls_last() if descending else time.asc_nulls_last(), F.col("source_id").asc(), F.col("line_number").asc()]


def after(cursor: Cursor) -> Column:
    """Rows that follow the cursor's key."""
    beyond = (F.col("source_id") > cursor.source_id) | ((F.col("source_id") == cursor.source_id) & (F.col("line_number") > cursor.line_number))
    if cursor.time is None:
        return F.col("timestamp_utc").isNull() & beyond
    at = F.timestamp_micros(F.lit(cursor.time))
    later = F.col("timestamp_utc") < at if cursor.descending else F.col("timestamp_utc") > at
    return later | ((F.col("timestamp_utc") == at) & beyond) | F.col("timestamp_utc").isNull()


def marked(logs: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """``logs`` with ``bookmarked``; keys of bookmarks are unique, so no row is repeated."""
    keys = bookmarks.select("source_id", "line_number", F.lit(True).alias("_marked")).distinct()
    return logs.join(keys, ["source_id", "line_number"], "left").withColumn("bookmarked", F.col("_marked").isNotNull()).drop("_marked")


def page_plan(logs: DataFrame, f: LogFilter, jobs: DataFrame, bookmarks: DataFrame, rows: int, descending: bool = False, cursor: Cursor | None = None, max_batch: int | None = None) -> DataFrame:
    """The rows of one page and one more; a top-k plan.  Bookmarks are joined to these rows only."""
    if not 1 <= rows <= PAGE_ROWS:
        raise FilterError(f"a page has 1 to {PAGE_ROWS} rows")
    if cursor is not None and (cursor.digest != f.digest() or cursor.descending != descending):
        raise FilterError("the cursor belongs to another query")
    found = apply_filter(logs, f, jobs, bookmarks)
    limit = cursor.max_batch if cursor else max_batch
    if limit is not None:
        found = frozen(found, limit)
    if cursor is not None:
        found = found.where(after(cursor))
    top = found.orderBy(*page_order(descending)).limit(rows + 1)
    return marked(top, bookmarks).select(*COLUMNS).orderBy(*page_order(descending))


def max_batch(logs: DataFrame) -> int:
    return logs.agg(F.coalesce(F.max("batch_id"), F.lit(0))).first()[0]


def batches_of_jobs(logs: DataFrame) -> DataFrame:
    """(job_id, batches, records, max_batch) of the rows that are there."""
    by_batch = logs.groupBy("job_id", "batch_id").agg(F.count("*").alias("n"))
    return by_batch.groupBy("job_id").agg(F.count("*").alias("batches"), F.sum("n").alias("records"), F.max("batch_id").alias("max_batch"))


def newest_of_lines(logs: DataFrame, sources: DataFrame) -> DataFrame:
    """``detail`` for all lines at once: (source_id, line_number, job_id, current_path) of each line's newest job."""
    newest = logs.groupBy("source_id", "line_number").agg(F.max("job_id").alias("job_id"))
    return newest.join(sources.select("source_id", "current_path"), "source_id")


def fetch_page(logs: DataFrame, f: LogFilter, jobs: DataFrame, bookmarks: DataFrame, rows: int = 200, descending: bool = False, cursor: Cursor | None = None) -> Page:
    limit = cursor.max_batch if cursor else max_batch(logs)
    plan = page_plan(logs, f, jobs, bookmarks, rows, descending, cursor, limit)
    return cut_page(plan.withColumn("_micros", F.unix_micros("timestamp_utc")).collect(), rows, f, descending, limit)


def cut_page(got: list, rows: int, f: LogFilter, descending: bool, limit: int | None) -> Page:
    """The page of rows that a plan found, one more than asked for if there are: cut at PAGE_BYTES, but never below one row."""
    kept, used = [], 0
    for row in got[:rows]:
        used += 48 + sum(len((row[c] or "").encode()) for c in _TEXTS)
        if kept and used > PAGE_BYTES:
            break
        kept.append(row)
    if len(kept) == len(got):
        return Page(kept, None)
    last = kept[-1]
    return Page(kept, Cursor(f.digest(), descending, limit, last["_micros"], last["source_id"], last["line_number"]))


def detail(logs: DataFrame, sources: DataFrame, source_id: int, line_number: int, job_id: int | None = None) -> DataFrame:
    """The row of a line with its source's path, of the newest job or the one given."""
    own = logs.where((F.col("source_id") == source_id) & (F.col("line_number") == line_number))
    if job_id is not None:
        own = own.where(F.col("job_id") == job_id)
    return own.join(sources.select("source_id", "original_path", "current_path"), "source_id").orderBy(F.col("job_id").desc()).limit(1)
