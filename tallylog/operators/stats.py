"""Statistics over filtered log rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallylog.operators.filters import FilterError
from tallylog.plans.schema import AUTO_BUCKETS, BUCKETS, TOP_N, TZ_OFFSET

#: fixed values: sizes of automatic buckets in seconds, and where buckets begin (a Monday)
SIZES = (60, 300, 900, 3600, 21_600, 86_400, 7 * 86_400, 30 * 86_400, 365 * 86_400)
ORIGIN = 946_857_600
NAMED = {"minute": 60, "hour": 3600, "day": 86_400, "week": 7 * 86_400}


def totals(logs: DataFrame) -> DataFrame:
    return logs.agg(
        F.count("*").alias("total"), F.count_if(F.col("timestamp_utc").isNull()).alias("without_time"),
        F.unix_micros(F.min("timestamp_utc")).alias("first_micros"), F.unix_micros(F.max("timestamp_utc")).alias("last_micros"),
    )


def by_status(logs: DataFrame) -> DataFrame:
    return logs.groupBy("status").agg(F.count("*").alias("n")).orderBy(F.col("status").asc_nulls_last())


def most(logs: DataFrame, value: Column, name: str, limit: int, nulls: bool = False) -> DataFrame:
    """The most frequent values: by count, then value."""
    named = logs.select(value.alias(name))
    if not nulls:
        named = named.where(F.col(name).isNotNull())
    return named.groupBy(name).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col(name).asc_nulls_last()).limit(limit)


def checked_top(n: int) -> int:
    if not 1 <= n <= TOP_N:
        raise FilterError(f"lists have 1 to {TOP_N} rows")
    return n


def by_method(logs: DataFrame) -> DataFrame:
    return most(logs, F.col("method"), "method", 50, nulls=True)


def top_targets(logs: DataFrame, n: int) -> DataFrame:
    return most(logs, F.col("request_target"), "request_target", checked_top(n))


def top_ips(logs: DataFrame, n: int) -> DataFrame:
    return most(logs, F.col("client_ip"), "client_ip", checked_top(n))


def by_level(logs: DataFrame) -> DataFrame:
    return most(logs, F.get_json_object("extra_json", "$.level"), "level", 50, nulls=True)


def top_messages(logs: DataFrame, n: int) -> DataFrame:
    return most(logs, F.get_json_object("extra_json", "$.message"), "message", checked_top(n))


def ip_activity(logs: DataFrame) -> DataFrame:
    """Requests and first and last time of every address."""
    return logs.where("client_ip is not null").groupBy("client_ip").agg(
        F.count("*").alias("n"), F.unix_micros(F.min("timestamp_utc")).alias("first_micros"), F.unix_micros(F.max("timestamp_utc")).alias("last_micros")
    )


def ip_rows(logs: DataFrame, n: int) -> DataFrame:
    return ip_activity(logs).orderBy(F.col("n").desc(), "client_ip").limit(checked_top(n))


def auto_bucket(first: int, last: int) -> int:
    """The smallest size, in seconds, that cuts a range of microseconds into at most AUTO_BUCKETS."""
    span = max(0, last - first) // 1_000_000
    return next((s for s in SIZES if span // s <= AUTO_BUCKETS), SIZES[-1])


def bucket_start(time: Column, seconds: int, offset: int = 0) -> Column:
    """Where the bucket of ``time`` begins, in microseconds; buckets are laid out in the display's offset."""
    micros = F.unix_micros(time)
    return micros - F.pmod(micros + (offset - ORIGIN) * 1_000_000, F.lit(seconds * 1_000_000))


def timeline(logs: DataFrame, seconds: int, offset: int = 0, limit: int | None = BUCKETS) -> DataFrame:
    if abs(offset) > TZ_OFFSET:
        raise FilterError("the offset is out of range")
    found = logs.where("timestamp_utc is not null").groupBy(bucket_start(F.col("timestamp_utc"), seconds, offset).alias("bucket_micros")).agg(F.count("*").alias("n")).orderBy("bucket_micros")
    return found if limit is None else found.limit(limit)


def auto_timeline(logs: DataFrame, offset: int = 0, limit: int | None = BUCKETS) -> DataFrame:
    """``timeline`` with the bucket size that suits the range of times."""
    span = totals(logs).first()
    return timeline(logs, auto_bucket(span["first_micros"] or 0, span["last_micros"] or 0), offset, limit)


def tallied(logs: DataFrame, values: dict[str, Column], seconds: int, offset: int = 0) -> DataFrame:
    """(dim, key, n, untimed, least, most) of every value of some columns, of all rows (``all``) and of buckets of time (``time``), in one scan.

    Each row is counted under all its values at once, within tasks before anything moves.
    """
    dims = {"all": F.lit(""), "time": bucket_start(F.col("timestamp_utc"), seconds, offset)} | values
    every = F.array(*[F.struct(F.lit(d).alias("dim"), v.cast("string").alias("key")) for d, v in dims.items()])
    rows = logs.select(F.unix_micros("timestamp_utc").alias("micros"), F.explode(every).alias("d"))
    return rows.groupBy("d.dim", "d.key").agg(F.count("*").alias("n"), F.count_if(F.col("micros").isNull()).alias("untimed"), F.min("micros").alias("least"), F.max("micros").alias("most"))


def compute(logs: DataFrame, kind: str | None, top_n: int = 20, bucket: str | int = "auto", offset: int = 0) -> dict[str, DataFrame | bool]:
    """All statistics of one filter, by name, from one scan of the rows; ``truncated`` tells whether the timeline had more buckets.

    The counts by value are kept until the results are read; ``table`` is what to unpersist.
    """
    if abs(offset) > TZ_OFFSET:
        raise FilterError("the offset is out of range")
    checked_top(top_n)
    error = kind == "error"
    values = {"ip": F.col("client_ip")} | ({n: F.get_json_object("extra_json", f"$.{n}") for n in ("level", "message")} if error else {n: F.col(c) for n, c in (("status", "status"), ("method", "method"), ("target", "request_target"))})
    given = NAMED.get(bucket, bucket)
    # the size that suits the range is known later; buckets of a minute add up to any of them
    base = math.gcd(60, offset % 60) if bucket == "auto" else given
    table = tallied(logs, values, base, offset).persist()
    of = lambda dim: table.where(F.col("dim") == dim)
    whole = of("all").first()
    span = [(whole["n"], whole["untimed"], whole["least"], whole["most"]) if whole else (0, 0, None, None)]
    size = auto_bucket(span[0][2] or 0, span[0][3] or 0) if bucket == "auto" else given
    named = lambda dim, name, limit, nulls=False, key=F.col("key"): (of(dim) if nulls else of(dim).where("key is not null")).select(key.alias(name), "n").orderBy(F.col("n").desc(), F.col(name).asc_nulls_last()).limit(limit)
    found: dict[str, DataFrame | bool] = {"totals": logs.sparkSession.createDataFrame(span, totals(logs).schema), "top_ips": named("ip", "client_ip", top_n)}
    found["ip_rows"] = of("ip").where("key is not null").select(F.col("key").alias("client_ip"), "n", F.col("least").alias("first_micros"), F.col("most").alias("last_micros")).orderBy(F.col("n").desc(), "client_ip").limit(top_n)
    if error:
        found |= {"levels": named("level", "level", 50, True), "top_messages": named("message", "message", top_n)}
    else:
        statuses = of("status").select(F.col("key").cast("int").alias("status"), "n").orderBy(F.col("status").asc_nulls_last())
        found |= {"status": statuses, "methods": named("method", "method", 50, True), "top_targets": named("target", "request_target", top_n)}
    start = bucket_start(F.timestamp_micros(F.col("key").cast("bigint")), size, offset)
    line = of("time").where("key is not null").groupBy(start.alias("bucket_micros")).agg(F.sum("n").alias("n")).orderBy("bucket_micros").limit(BUCKETS + 1)
    # at most BUCKETS + 1 rows, so these are fetched once
    rows = line.collect()
    found["timeline"] = logs.sparkSession.createDataFrame(rows[:BUCKETS], line.schema)
    found["truncated"] = len(rows) > BUCKETS
    found["table"] = table
    return found


def ip_order(rows: DataFrame, by: str = "count", descending: bool = True) -> DataFrame:
    """Rows of addresses sorted by ``count``, ``first`` or ``last`` time, then by address; no first time counts as the latest, no last time as the earliest."""
    key = {"count": F.col("n"), "first": F.coalesce("first_micros", F.lit((1 << 53) - 1)), "last": F.coalesce("last_micros", F.lit(-1))}[by]
    return rows.orderBy(key.desc() if descending else key.asc(), "client_ip")


def ranked(ips: DataFrame) -> DataFrame:
    """A bounded list of addresses with its rank column."""
    return ips.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), "client_ip")))


def ranked_by(ips: DataFrame) -> DataFrame:
    """(client_ip, rank) of a bounded, sorted list of addresses."""
    return ips.coalesce(1).select("client_ip", (F.monotonically_increasing_id() + 1).alias("rank"))
