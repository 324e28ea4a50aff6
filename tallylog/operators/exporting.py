"""CSV and JSON Lines, as one rendered text column, so quoting is the format's own and not Spark's."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tallylog.functions.display import iso_utc
from tallylog.operators.filters import LogFilter, apply_filter
from tallylog.operators.paging import page_order
from tallylog.plans.lease import Stoppable, Stopped, stop
from tallylog.sources.storage import storage

if TYPE_CHECKING:
    from tallylog.plans.store import Store

#: files of a store that one slice of an export reads, about
SLICE_FILES = 64

COLUMNS = (
    "job_id", "source_id", "line_number", "timestamp_utc", "tz_offset_seconds", "client_ip", "method", "request_target", "protocol", "status", "bytes_sent",
    "referrer", "user_agent",
)


def csv_field(value: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[,"\\n\\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_header(include_extra: bool = True) -> str:
    return ",".join((*COLUMNS, "extra_json") if include_extra else COLUMNS)


def csv_lines(logs: DataFrame, include_extra: bool = True) -> DataFrame:
    names = (*COLUMNS, "extra_json") if include_extra else COLUMNS
    cells = [iso_utc(F.col(n)) if n == "timestamp_utc" else csv_field(F.col(n)) for n in names]
    return logs.select("timestamp_utc", "source_id", "line_number", F.concat_ws(",", *cells).alias("line"))


def json_lines(logs: DataFrame, include_extra: bool = True) -> DataFrame:
    """One object a row; the extra fields as an object, null where there are none."""
    cells = [(F.when(F.col(n).isNotNull(), iso_utc(F.col(n))) if n == "timestamp_utc" else F.col(n)).alias(n) for n in COLUMNS]
    extra = F.from_json("extra_json", "map<string,string>") if include_extra else F.lit(None).cast("map<string,string>")
    text = F.to_json(F.struct(*cells, extra.alias("extra")), {"ignoreNullFields": "false"})
    return logs.select("timestamp_utc", "source_id", "line_number", text.alias("line"))


def export(lines: DataFrame, path: str, header: str | None = None, max_rows: int | None = None, descending: bool = False, single: bool = False) -> bool:
    """Write the rendered lines in page order; True if ``max_rows`` left rows out.

    Files follow each other in order; ``single`` gives one file, for exports that fit one writer.
    """
    if header is not None:
        first = lines.sparkSession.createDataFrame([(header,)], "line string")
        first.coalesce(1).write.mode("error").text(f"{path}/header")
    written = _written(lines, f"{path}/rows" if header is not None else path, max_rows, descending, single)
    return written == max_rows and lines.limit(max_rows + 1).count() > max_rows


def _written(lines: DataFrame, path: str, most: int | None, descending: bool, single: bool = False) -> int:
    """Write lines in page order, ``most`` at most; how many there were, counted as they are written."""
    told = Observation()
    ordered = lines.orderBy(*page_order(descending)).select("line")
    ordered = ordered if most is None else ordered.limit(most)
    (ordered.coalesce(1) if single else ordered).observe(told, F.count("*").alias("n")).write.text(path)
    return told.get["n"]


@dataclass
class Exported:
    rows: int
    max_batch: int
    truncated: bool = False
    cancelled: bool = False


def export_store(store: Store, f: LogFilter, path: str, form: str = "csv", include_extra: bool = True, max_rows: int | None = None, descending: bool = False, name: str = "export", progress: Callable[[Exported], None] | None = None) -> Exported:
    """Write the rows of a store that ``f`` lets pass, up to the batch that is the last one now, in slices of time.

    A slice is a job that writes one folder, and reads only files of its time.  ``stop_export``,
    from any process, ends the export; the slices that are written stay.
    """
    slices = store.time_slices(f, SLICE_FILES)
    found = Exported(0, store.max_batch())
    out = storage(store.spark, path)
    if out.names(""):
        raise ValueError("the folder isn't empty")
    if form == "csv":
        out.create("header.csv", f"{csv_header(include_extra)}\n".encode())
    render = csv_lines if form == "csv" else json_lines
    try:
        with Stoppable(store.spark, store.files, f"export-{name}") as work:
            for k, (logs, condition) in enumerate(reversed(slices) if descending else slices):
                work.check()
                kept = apply_filter(logs, f, store.jobs(), store.bookmarks()).where(condition).where(F.col("batch_id") <= found.max_batch)
                left = None if max_rows is None else max_rows - found.rows
                if left == 0:
                    if not kept.isEmpty():
                        found.truncated = True
                        break
                    continue
                try:
                    n = _written(render(kept, include_extra), f"{out.url}/rows/slice={k:06d}", left, descending)
                except BaseException:
                    out.delete(f"rows/slice={k:06d}")
                    raise
                found.rows += n
                if left is not None and n == left and kept.limit(n + 1).count() > n:
                    found.truncated = True
                    break
                if progress:
                    progress(found)
    except Stopped:
        found.cancelled = True
    return found


def stop_export(store: Store, name: str = "export") -> None:
    stop(store.files, f"export-{name}")


#: fixed value: the first line of the table of addresses
IP_HEADER = "ip,first_seen_utc,last_seen_utc,count"


def ip_csv(activity: DataFrame) -> DataFrame:
    """All addresses, most frequent first."""
    time = lambda c: iso_utc(F.timestamp_micros(c))
    return activity.orderBy(F.col("n").desc(), "client_ip").select(F.concat_ws(",", csv_field(F.col("client_ip")), F.coalesce(time("first_micros"), F.lit("")), F.coalesce(time("last_micros"), F.lit("")), F.col("n").cast("string")).alias("line"))
