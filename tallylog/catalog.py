"""Queries over the demo logs by name, and DuckDB SQL for the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylog.functions import display
from tallylog.operators import builtin_rules, exporting, filters, paging, reconstruct, stats
from tallylog.operators.filters import Always, And, Cond, Expr, LogFilter, Not, Or
from tallylog.plans import demo_logs
from tallylog.plans.store import Store
from tallylog.sources import formats, lines, parse, storage

KEY = ("job_id", "source_id", "line_number")
_WITH = f"WITH logs AS ({demo_logs.LOGS_SQL}), jobs AS ({demo_logs.JOBS_SQL}), sources AS ({demo_logs.SOURCES_SQL}), bookmarks AS ({demo_logs.BOOKMARKS_SQL}) "
_FIELD = {"level": "json_extract_string(extra_json, '$.level')", "message": "json_extract_string(extra_json, '$.message')", "extra": "extra_json"}
_COMPARE = {"eq": "=", "ne": "<>", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def expr_sql(e: Expr) -> str:
    """The tree as DuckDB SQL, whose engine then matches the patterns."""
    match e:
        case Always() | And(()) | Or(()):
            return "TRUE"
        case And(items):
            return "(" + " AND ".join(map(expr_sql, items)) + ")"
        case Or(items):
            return "(" + " OR ".join(map(expr_sql, items)) + ")"
        case Not(item):
            return f"(NOT {expr_sql(item)})"
    col, value = _FIELD.get(e.field, e.field), quoted(e.value)
    if e.op == "is_null":
        return f"({col} IS NULL)"
    if e.op in _COMPARE:
        return f"({col} {_COMPARE[e.op]} {e.value if e.field in filters.NUMERIC else value})"
    return {
        "contains": f"contains({col}, {value})", "icontains": f"contains(lower({col}), lower({value}))", "starts_with": f"starts_with({col}, {value})",
        "ends_with": f"ends_with({col}, {value})", "regex": f"regexp_matches({col}, {value})",
    }[e.op]


def filter_sql(f: LogFilter) -> str:
    parts = [f"{n} = {v if isinstance(v, int) else quoted(v)}" for n in ("job_id", "source_id", "status", "client_ip", "method") if (v := getattr(f, n)) is not None]
    if f.time_from is not None:
        parts.append(f"timestamp_utc >= make_timestamp({f.time_from})")
    if f.time_to is not None:
        parts.append(f"timestamp_utc < make_timestamp({f.time_to})")
    if f.status_class is not None:
        parts.append(f"status >= {f.status_class * 100} AND status < {f.status_class * 100 + 100}")
    if f.target_contains is not None:
        parts.append(f"contains(request_target, {quoted(f.target_contains)})")
    if f.target_regex is not None:
        parts.append(f"regexp_matches(request_target, {quoted(f.target_regex)})")
    if f.active_only:
        parts.append("job_id IN (SELECT job_id FROM jobs WHERE active)")
    if f.log_kind is not None:
        parts.append(f"job_id IN (SELECT job_id FROM jobs WHERE coalesce(log_kind, 'access') = '{f.log_kind}')")
    if f.bookmarked_only:
        parts.append("EXISTS (SELECT 1 FROM bookmarks b WHERE b.source_id = logs.source_id AND b.line_number = logs.line_number)")
    if f.expr is not None:
        parts.append(expr_sql(f.expr))
    return " AND ".join(f"({p})" for p in parts) or "TRUE"


def add(name: str, build: Callable[[dict[str, DataFrame]], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(demo_logs.tables(spark, sf_dir))
    ORACLE[name] = _WITH + sql


def kept(t: dict[str, DataFrame], f: LogFilter) -> DataFrame:
    return filters.apply_filter(t["logs"], f, t["jobs"], t["bookmarks"])


def add_filter(name: str, f: LogFilter) -> None:
    add(name, lambda t: kept(t, f).select(*KEY), f"SELECT {', '.join(KEY)} FROM logs WHERE {filter_sql(f)}")


DAY = 1_704_758_400_000_000  # 2024-01-09T00:00Z, in microseconds
ALL = LogFilter(active_only=True, log_kind="access")
ERRORS = LogFilter(active_only=True, log_kind="error")

for _name, _f in {
    "filter_job": LogFilter(job_id=2), "filter_source": LogFilter(source_id=2), "filter_time_range": LogFilter(time_from=DAY, time_to=DAY + 86_400_000_000),
    "filter_status": LogFilter(status=500), "filter_status_class": LogFilter(status_class=4), "filter_ip": LogFilter(client_ip="10.0.1.13"),
    "filter_method": LogFilter(method="POST"), "filter_target_contains": LogFilter(target_contains="etc/passwd"),
    "filter_target_regex": LogFilter(target_regex=r"(?i)\.JS\b|union[%20\s]+"), "filter_active_only": LogFilter(active_only=True),
    "filter_log_kind": LogFilter(log_kind="error"), "filter_bookmarked": LogFilter(bookmarked_only=True),
    "filter_combined": LogFilter(active_only=True, log_kind="access", status_class=2, method="GET", target_contains="/", time_from=DAY),
}.items():
    add_filter(_name, _f)

for _name, _e in {
    "expr_or_and_not": Or((Cond("status", "gte", "500"), And((Cond("method", "eq", "POST"), Not(Cond("request_target", "ends_with", "2")))))),
    "expr_empty_and_or_true": And((Or(()), And(()), Cond("status", "eq", "404"))),
    "expr_numeric_ops": And((Cond("status", "gt", "200"), Cond("status", "lte", "500"), Cond("bytes_sent", "lt", " 5000 "), Cond("bytes_sent", "ne", "0"))),
    "expr_icontains": Cond("user_agent", "icontains", "NIKTO"),
    "expr_starts_ends": Or((Cond("request_target", "starts_with", "/static"), Cond("referrer", "ends_with", "0"))),
    "expr_is_null": Cond("user_agent", "is_null"),
    "expr_not_null_semantics": Not(Cond("user_agent", "eq", "curl/8.6.0")),
    "expr_level": Cond("level", "regex", "(?i)ERROR$"),
    "expr_message": Cond("message", "ne", "signal process started"),
    "expr_extra": Cond("extra", "contains", '"level":"warn"'),
    "expr_protocol_referrer": And((Cond("protocol", "eq", "HTTP/1.1"), Cond("referrer", "contains", "http"))),
    "quick_search_access": filters.quick_access("SQLMAP"),
    "quick_search_error": filters.quick_error("refused"),
}.items():
    add_filter(_name, LogFilter(expr=_e))
add_filter("scope_whitelist", filters.with_scope(LogFilter(expr=Cond("status", "eq", "200")), DAY, DAY + 7 * 86_400_000_000, ["10.0.1.*", "10.0.2.2"]))
add_filter("bookmark_screen", filters.bookmark_filter(LogFilter(log_kind="access", expr=Cond("status", "lt", "500"))))
add("frozen_batch_range", lambda t: filters.frozen(kept(t, ALL), 5).select(*KEY), f"SELECT {', '.join(KEY)} FROM logs WHERE {filter_sql(ALL)} AND batch_id <= 5")
add("count_matching", lambda t: kept(t, ALL).agg(F.count("*").alias("n")), f"SELECT count(*) AS n FROM logs WHERE {filter_sql(ALL)}")
add("max_batch_per_job", lambda t: paging.batches_of_jobs(t["logs"]).select("job_id", "max_batch"), "SELECT job_id, max(batch_id) AS max_batch FROM logs GROUP BY job_id")

for _rule in (*builtin_rules.ACCESS, *builtin_rules.ERROR):
    _kind, _parsed = builtin_rules.builtin(_rule)
    add_filter(f"rule_{_rule}", LogFilter(active_only=True, log_kind=_kind, expr=_parsed.expr))

_PAGE = "job_id, source_id, line_number, epoch_us(timestamp_utc) AS micros, client_ip, method, request_target, status, bytes_sent, extra_json, EXISTS (SELECT 1 FROM bookmarks b WHERE b.source_id = logs.source_id AND b.line_number = logs.line_number) AS bookmarked"


def add_page(name: str, f: LogFilter, rows: int, descending: bool, cursor: paging.Cursor | None = None, where: str = "TRUE") -> None:
    def build(t: dict[str, DataFrame]) -> DataFrame:
        found = paging.page_plan(t["logs"], f, t["jobs"], t["bookmarks"], rows, descending, cursor)
        return found.withColumn("micros", F.unix_micros("timestamp_utc")).drop("timestamp_utc")

    order = f"timestamp_utc {'DESC' if descending else 'ASC'} NULLS LAST, source_id, line_number"
    add(name, build, f"SELECT {_PAGE} FROM logs WHERE {filter_sql(f)} AND {where} ORDER BY {order} LIMIT {rows + 1}")


add_page("page_time_asc", ALL, 200, False)
add_page("page_time_desc_nulls_last", ALL, 200, True)
add_page("page_next_cursor", ALL, 200, False, paging.Cursor(ALL.digest(), False, None, DAY, 1, 50), f"(timestamp_utc > make_timestamp({DAY}) OR timestamp_utc = make_timestamp({DAY}) AND (source_id > 1 OR source_id = 1 AND line_number > 50) OR timestamp_utc IS NULL)")
add_page("page_next_cursor_desc", ALL, 100, True, paging.Cursor(ALL.digest(), True, None, DAY, 1, 50), f"(timestamp_utc < make_timestamp({DAY}) OR timestamp_utc = make_timestamp({DAY}) AND (source_id > 1 OR source_id = 1 AND line_number > 50) OR timestamp_utc IS NULL)")
add_page("page_null_segment", ALL, 50, True, paging.Cursor(ALL.digest(), True, None, None, 1, 500), "timestamp_utc IS NULL AND (source_id > 1 OR source_id = 1 AND line_number > 500)")
add_page("page_status_500", LogFilter(active_only=True, status=500), 200, False)
add("page_bookmark_flag", lambda t: paging.marked(kept(t, ALL), t["bookmarks"]).groupBy("bookmarked").agg(F.count("*").alias("n")), f"SELECT bookmarked, count(*) AS n FROM (SELECT {_PAGE} FROM logs WHERE {filter_sql(ALL)}) GROUP BY bookmarked")
add("detail_join_source", lambda t: paging.detail(t["logs"], t["sources"], 1, 42).select("job_id", "source_id", "line_number", "request_target", "original_path", "current_path"), "SELECT job_id, source_id, line_number, request_target, original_path, current_path FROM logs JOIN sources USING (source_id) WHERE source_id = 1 AND line_number = 42 ORDER BY job_id DESC LIMIT 1")
add("detail_latest_job", lambda t: paging.newest_of_lines(t["logs"], t["sources"]).select("source_id", "line_number", "job_id", "current_path"), "SELECT source_id, line_number, max(job_id) AS job_id, any_value(current_path) AS current_path FROM logs JOIN sources USING (source_id) GROUP BY source_id, line_number")

_A, _E = f"FROM logs WHERE {filter_sql(ALL)}", f"FROM logs WHERE {filter_sql(ERRORS)}"
_LEVEL, _MESSAGE = _FIELD["level"], _FIELD["message"]
add("stats_totals", lambda t: stats.totals(kept(t, ALL)), f"SELECT count(*) AS total, count(*) FILTER (timestamp_utc IS NULL) AS without_time, epoch_us(min(timestamp_utc)) AS first_micros, epoch_us(max(timestamp_utc)) AS last_micros {_A}")
add("stats_status", lambda t: stats.by_status(kept(t, ALL)), f"SELECT status, count(*) AS n {_A} GROUP BY status")
add("stats_methods", lambda t: stats.by_method(kept(t, ALL)), f"SELECT method, count(*) AS n {_A} GROUP BY method ORDER BY n DESC, method LIMIT 50")
add("stats_top_targets", lambda t: stats.top_targets(kept(t, ALL), 20), f"SELECT request_target, count(*) AS n {_A} AND request_target IS NOT NULL GROUP BY request_target ORDER BY n DESC, request_target LIMIT 20")
add("stats_top_ips", lambda t: stats.top_ips(kept(t, ALL), 20), f"SELECT client_ip, count(*) AS n {_A} AND client_ip IS NOT NULL GROUP BY client_ip ORDER BY n DESC, client_ip LIMIT 20")
_IP = "SELECT client_ip, count(*) AS n, epoch_us(min(timestamp_utc)) AS first_micros, epoch_us(max(timestamp_utc)) AS last_micros"
add("stats_ip_rows", lambda t: stats.ip_rows(kept(t, ALL), 30), f"{_IP} {_A} AND client_ip IS NOT NULL GROUP BY client_ip ORDER BY n DESC, client_ip LIMIT 30")
add("stats_ip_all", lambda t: stats.ip_activity(kept(t, ALL)), f"{_IP} {_A} AND client_ip IS NOT NULL GROUP BY client_ip")
add("stats_ip_rank", lambda t: stats.ranked(stats.top_ips(kept(t, ALL), 10)), f"SELECT client_ip, n, row_number() OVER (ORDER BY n DESC, client_ip) AS rank FROM (SELECT client_ip, count(*) AS n {_A} AND client_ip IS NOT NULL GROUP BY client_ip ORDER BY n DESC, client_ip LIMIT 10)")
add("stats_levels", lambda t: stats.by_level(kept(t, ERRORS)), f"SELECT {_LEVEL} AS level, count(*) AS n {_E} GROUP BY 1 ORDER BY n DESC, level LIMIT 50")
add("stats_top_messages", lambda t: stats.top_messages(kept(t, ERRORS), 10), f"SELECT {_MESSAGE} AS message, count(*) AS n {_E} AND {_MESSAGE} IS NOT NULL GROUP BY 1 ORDER BY n DESC, message LIMIT 10")


def add_timeline(name: str, seconds: int, offset: int = 0) -> None:
    start = f"epoch_us(timestamp_utc) - (((epoch_us(timestamp_utc) + {(offset - stats.ORIGIN) * 1_000_000}) % {seconds * 1_000_000}) + {seconds * 1_000_000}) % {seconds * 1_000_000}"
    add(name, lambda t: stats.timeline(kept(t, ALL), seconds, offset), f"SELECT {start} AS bucket_micros, count(*) AS n {_A} AND timestamp_utc IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT {2000}")


add_timeline("timeline_minute", 60)
add_timeline("timeline_hour", 3600)
add_timeline("timeline_day_offset", 86_400, 32_400)
add_timeline("timeline_week", 7 * 86_400)
add_timeline("timeline_month", 30 * 86_400, -18_000)
_SIZE = "(SELECT min(s) FROM (SELECT unnest([" + ", ".join(map(str, stats.SIZES)) + f"]::BIGINT[]) AS s), (SELECT max(timestamp_utc) AS b, min(timestamp_utc) AS a {_A}) WHERE (epoch_us(b) - epoch_us(a)) // 1000000 // s <= 400)"
add("timeline_auto", lambda t: stats.auto_timeline(kept(t, ALL)), f"SELECT epoch_us(timestamp_utc) - (epoch_us(timestamp_utc) - {stats.ORIGIN * 1_000_000}) % ({_SIZE} * 1000000) AS bucket_micros, count(*) AS n {_A} AND timestamp_utc IS NOT NULL GROUP BY 1")
add("stats_ip_first_order", lambda t: stats.ranked_by(stats.ip_order(stats.ip_rows(kept(t, ALL), 30), "first", False)), f"SELECT client_ip, row_number() OVER (ORDER BY coalesce(first_micros, 9007199254740991), client_ip) AS rank FROM ({_IP} {_A} AND client_ip IS NOT NULL GROUP BY client_ip ORDER BY n DESC, client_ip LIMIT 30)")

# --- display: the SQL follows the interface's own rules; listed cases tell their variants apart ---

_CASES = "CASE WHEN status >= 500 THEN 's5' WHEN status >= 400 THEN 's4' WHEN status >= 300 THEN 's3' WHEN status >= 200 THEN 's2' ELSE 's0' END"
add("status_class_label", lambda t: t["logs"].groupBy(display.status_class(F.col("status")).alias("class")).agg(F.count("*").alias("n")), f"SELECT {_CASES} AS class, count(*) AS n FROM logs GROUP BY 1")
_METHODS = "CASE WHEN coalesce(method, '') = '' THEN 'm-none' WHEN upper(method) IN ('GET', 'HEAD', 'OPTIONS', 'TRACE') THEN 'm-read' WHEN upper(method) IN ('POST', 'PUT', 'PATCH', 'CONNECT') THEN 'm-write' WHEN upper(method) = 'DELETE' THEN 'm-del' ELSE 'm-odd' END"
add("method_class_label", lambda t: t["logs"].groupBy(display.method_class(F.col("method")).alias("class")).agg(F.count("*").alias("n")), f"SELECT {_METHODS} AS class, count(*) AS n FROM logs GROUP BY 1")
_SHOWN = f"coalesce({_LEVEL}, '')"
add("level_class_label", lambda t: kept(t, ERRORS).groupBy(display.level_class(display.error_level(F.col("extra_json"))).alias("class")).agg(F.count("*").alias("n")), f"SELECT CASE WHEN regexp_matches(lower({_SHOWN}), 'emerg|alert|crit|error') THEN 's5' WHEN contains(lower({_SHOWN}), 'warn') THEN 's4' ELSE 's0' END AS class, count(*) AS n {_E} GROUP BY 1")
_TEXT = f"coalesce({_MESSAGE}, '')"
_ACCESS = "concat_ws(' · ', nullif(concat_ws(' ', nullif(method, ''), nullif(request_target, '')), ''), CAST(status AS VARCHAR), client_ip)"
add("row_summary", lambda t: t["logs"].select(*KEY, display.row_summary().alias("summary")), f"SELECT {', '.join(KEY)}, coalesce(nullif(CASE WHEN {_TEXT} = '' THEN {_ACCESS} ELSE concat_ws(' · ', nullif({_SHOWN}, ''), {_TEXT}, client_ip) END, ''), '(내용 없음)') AS summary FROM logs")
add("error_row_fields", lambda t: kept(t, ERRORS).select(*KEY, display.error_level(F.col("extra_json")).alias("level"), display.error_client(F.col("client_ip"), F.col("extra_json")).alias("client"), display.error_text(F.col("extra_json")).alias("message")), f"SELECT {', '.join(KEY)}, {_SHOWN} AS level, coalesce(client_ip, '') AS client, {_TEXT} AS message {_E}")


_METHOD = "CASE WHEN line_number % 2 = 0 THEN lower(method) ELSE method END"
add("method_class_cases", lambda t: t["logs"].select(*KEY, display.method_class(F.when(F.col("line_number") % 2 == 0, F.lower("method")).otherwise(F.col("method"))).alias("text")), f"SELECT {', '.join(KEY)}, CASE WHEN m IS NULL THEN 'm-none' WHEN upper(m) IN ('GET', 'HEAD', 'OPTIONS', 'TRACE') THEN 'm-read' WHEN upper(m) IN ('POST', 'PUT', 'PATCH', 'CONNECT') THEN 'm-write' WHEN upper(m) = 'DELETE' THEN 'm-del' ELSE 'm-odd' END AS text FROM (SELECT *, {_METHOD} AS m FROM logs)")
add("level_class_cases", lambda t: kept(t, ERRORS).select(*KEY, display.level_class(F.concat(F.lit("mod"), F.col("line_number") % 7, F.lit(":"), F.upper(display.error_level(F.col("extra_json"))))).alias("text")), f"SELECT {', '.join(KEY)}, CASE WHEN regexp_matches(lower({_SHOWN}), 'emerg|alert|crit|error') THEN 's5' WHEN contains(lower({_SHOWN}), 'warn') THEN 's4' ELSE 's0' END AS text {_E}")
# the fields of access rows as an error's: without a message, all of them but the client
add(
    "error_text_cases",
    lambda t: kept(t, ALL).select(*KEY, display.error_text(F.to_json(F.struct(F.col("method").alias("a"), F.col("request_target").alias("b"), F.col("client_ip").alias("client"), F.col("status").cast("string").alias("error_code"), F.col("user_agent").alias("message")))).alias("text")),
    f"SELECT {', '.join(KEY)}, CASE WHEN user_agent IS NULL THEN concat_ws(', ', 'a=' || method, 'b=' || request_target, 'error_code=' || status) WHEN status IS NULL THEN user_agent ELSE status || ' ' || user_agent END AS text {_A}",
)
escaped = lambda c, mark: F.regexp_replace(F.hex(F.col(c).cast("binary")), "(..)", f"{mark}$1")
add("url_decoded_cases", lambda t: t["logs"].select(*KEY, display.url_decoded(F.concat(escaped("referrer", "%"), F.lit("%zz%ff+"))).alias("text")), f"SELECT {', '.join(KEY)}, referrer || '%zz%ff+' AS text FROM logs")
add("hex_decoded_cases", lambda t: t["logs"].select(*KEY, display.hex_decoded(F.concat(escaped("request_target", r"\\x"), F.lit(r"\x00\xff"))).alias("text")), f"SELECT {', '.join(KEY)}, request_target || '··' AS text FROM logs")
# every row has one of the listed texts by its line, and a greeting whose version comes from the row
_TLS = " ClientHello — HTTPS 핸드셰이크를 HTTP 포트로 보냄"
_GREETINGS = [
    (r"\x16\x03\x01\x02\x00\x01\x00\x01\xFC\x03\x03", "TLS 1.2+" + _TLS), (r"\x16\x03\x01\x02\x00\x01\x00\x01\xFC\x03\x02", "TLS 1.1" + _TLS), (r"\x16\x03\x01\x02\x00\x01\x00\x01\xFC\x03\x01", "TLS 1.0" + _TLS),
    (r"\x16\x03\x01\x02\x00\x01", "TLS" + _TLS), (r"\x16\x03\x01\x02\x00\x02", None), (r"\x16\x03\x05\x02\x00\x01", None), (r"\x80.\x01\x03", "SSLv2 ClientHello(구식 스캐너)"), (r"\x05\x02\x00\x02", "SOCKS5 핸드셰이크"),
    (r"\x05\x03", "SOCKS5 핸드셰이크"), (r"\x05\x04", None), (r"\x04\x01\x00P", "SOCKS4 CONNECT"), (r"\x00\x00\x00\x08", "길이 접두 이진 프로토콜(예: RDP/Java 직렬화)"), (r"\x00\x00\x00\x07", None), ("GET / HTTP/1.1", None),
]


def _protocols(logs: DataFrame) -> DataFrame:
    listed = F.array(*[F.lit(a) for a, _ in _GREETINGS])
    own = F.when(F.col("method") == "GET", F.concat(F.lit(r"\x16\x03\x01\x02\x00\x01\x00\x01\xFC\x03\x0"), F.col("line_number") % 4)).when(F.col("method") == "POST", F.lit(r"\x05\x01")).otherwise(F.concat(F.lit(r"\x47"), "request_target"))
    return logs.select(*KEY, display.protocol_guess(F.element_at(listed, (F.col("line_number") % len(_GREETINGS) + 1).cast("int"))).alias("text"), display.protocol_guess(own).alias("own_text"))


_told = lambda text: "NULL" if text is None else quoted(text)
add(
    "protocol_cases",
    lambda t: _protocols(t["logs"]),
    f"SELECT {', '.join(KEY)}, (CASE line_number % {len(_GREETINGS)} {' '.join(f'WHEN {k} THEN {_told(b)}' for k, (_, b) in enumerate(_GREETINGS))} END) AS text, "
    f"CASE WHEN method = 'GET' THEN ['TLS', 'TLS 1.0', 'TLS 1.1', 'TLS 1.2+'][line_number % 4 + 1] || '{_TLS}' WHEN method = 'POST' THEN 'SOCKS5 핸드셰이크' END AS own_text FROM logs",
)
_HELLO = r"\x16\x03\x01\x00\x50\x01\x00\x00\x4C\x03\x03" + "r" * 32 + r"\x02ab\x00\x02cc\x01\x00"


def greeting(host: Column) -> Column:
    """A greeting that asks for a host."""
    size = lambda more: F.concat(F.lit(r"\x00\x"), F.lpad(F.hex(F.length(host) + more), 2, "0"))
    return F.concat(F.lit(_HELLO), size(9), F.lit(r"\x00\x00"), size(5), size(3), F.lit(r"\x00"), size(0), host)


add("server_name_cases", lambda t: t["logs"].select(*KEY, display.server_name(greeting(F.split_part("referrer", F.lit("/"), F.lit(3)))).alias("text")), f"SELECT {', '.join(KEY)}, split_part(referrer, '/', 3) AS text FROM logs")
natural = lambda names: F.transform(F.array_sort(F.transform(names, lambda n: F.struct(display.natural_key(n).alias("k"), n.alias("n")))), lambda s: s["n"])
add("natural_name_order", lambda t: t["logs"].select(*KEY, F.array_join(natural(F.transform(F.array(F.col("line_number"), F.col("line_number") * 7 % 1000, F.lit(99)), lambda n: F.concat(F.lit("log."), n.cast("string")))), " ").alias("text")), f"SELECT {', '.join(KEY)}, array_to_string(list_transform(list_sort([line_number, line_number * 7 % 1000, 99]), lambda n: 'log.' || n), ' ') AS text FROM logs")
add("base_name_cases", lambda t: t["logs"].select(*KEY, display.base_name(F.coalesce("referrer", "request_target")).alias("text")), f"SELECT {', '.join(KEY)}, coalesce(list_filter(string_split_regex(coalesce(referrer, request_target), '[/\\\\]+'), lambda x: x <> '')[-1], '') AS text FROM logs")

_ISO = "coalesce(strftime(timestamp_utc, '%Y-%m-%dT%H:%M:%S.%fZ'), '')"
_CELLS = [
    _ISO if c == "timestamp_utc" else f"CASE WHEN regexp_matches(coalesce(CAST({c} AS VARCHAR), ''), '[,\"\\n\\r]') THEN '\"' || replace(CAST({c} AS VARCHAR), '\"', '\"\"') || '\"' ELSE coalesce(CAST({c} AS VARCHAR), '') END"
    for c in (*exporting.COLUMNS, "extra_json")
]
add("export_csv_lines", lambda t: exporting.csv_lines(kept(t, LogFilter(active_only=True))).select("source_id", "line_number", "line"), f"SELECT source_id, line_number, concat_ws(',', {', '.join(_CELLS)}) AS line FROM logs WHERE job_id IN (SELECT job_id FROM jobs WHERE active)")

# --- parsing: lines are built from the demo rows, parsed back, and compared with the rows ---

_CLF_SQL = "strftime(timestamp_utc, '%d/%b/%Y:%H:%M:%S')"
_SECOND = "epoch_us(date_trunc('second', timestamp_utc))"
#: by line number modulo 10: what is spoiled in a line, and the error that it gives
_SPOILED = {1: ("invalid_ip", "client_ip"), 2: ("invalid_status", "status"), 3: ("invalid_timestamp", "timestamp"), 4: ("no_match", None), 5: ("invalid_integer", "bytes_sent")}


def clf_time() -> Column:
    return F.date_format("timestamp_utc", "dd/MMM/yyyy:HH:mm:ss")


def dashed(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("-"))


def request_text() -> Column:
    """The request of a row, or a dash."""
    return F.coalesce(F.nullif(F.concat_ws(" ", "method", "request_target", "protocol"), F.lit("")), F.lit("-"))


def common_lines(logs: DataFrame, spoil: bool = False, tail: Column | None = None) -> DataFrame:
    """Each row as a line of the common format, a dash for what isn't there."""
    turn = F.col("line_number") % 10
    pick = lambda k, bad, good: F.when(turn == k, bad).otherwise(good) if spoil else good
    time = F.coalesce(F.concat(clf_time(), F.lit(" +0000")), F.lit("-"))
    line = F.concat(
        pick(1, F.lit("300.1.1.1"), dashed("client_ip")), F.lit(" - - ["), pick(3, F.lit("31/Feb/2024:00:00:00 +0000"), time), F.lit('] "'), request_text(), F.lit('" '),
        pick(2, F.lit("999"), dashed("status")), F.lit(" "), pick(5, F.lit("1x"), dashed("bytes_sent")), pick(4, F.lit(" more"), F.lit("")), F.lit("") if tail is None else tail,
    )
    return logs.select("source_id", "line_number", line.alias("value"))


def combined_lines(logs: DataFrame) -> DataFrame:
    return common_lines(logs, tail=F.concat(F.lit(' "'), dashed("referrer"), F.lit('" "'), dashed("user_agent"), F.lit('"')))


def w3c_lines(logs: DataFrame) -> DataFrame:
    """Each source's rows as W3C lines below a header at line 0; from line 501 on they are one line lower, below another header."""
    stamp = F.concat_ws(" ", F.coalesce(F.date_format("timestamp_utc", "yyyy-MM-dd"), F.lit("-")), F.coalesce(F.date_format("timestamp_utc", "HH:mm:ss"), F.lit("-")))
    late = F.col("line_number") > 500
    first = F.concat_ws(" ", stamp, *map(dashed, ("client_ip", "method", "request_target", "status")))
    second = F.concat_ws(" ", stamp, *map(dashed, ("client_ip", "request_target", "bytes_sent")))
    body = logs.select("source_id", (F.col("line_number") + late.cast("int")).alias("line_number"), F.when(late, second).otherwise(first).alias("value"))
    heads = logs.sparkSession.createDataFrame([(s, n, v) for s in (1, 2) for n, v in ((0, "#Fields: date time c-ip cs-method cs-uri-stem sc-status"), (501, "#Fields: date time c-ip cs-uri-stem sc-bytes"))], "source_id long, line_number long, value string")
    return body.unionByName(heads)


def _parsed(t: DataFrame, name: str) -> DataFrame:
    found = parse.records(parse.parse(t, formats.preset(name)))
    return found.withColumn("micros", F.unix_micros("timestamp_utc")).drop("timestamp_utc")


_COLUMNS = "source_id, line_number, tz_offset_seconds, client_ip, method, request_target, protocol, status, bytes_sent"
_NAMES = _COLUMNS.split(", ")
add("parse_common", lambda t: _parsed(common_lines(t["logs"]), "common").select(*_NAMES, "micros"), f"SELECT {_COLUMNS}, {_SECOND} AS micros FROM logs")
add("parse_combined_roundtrip", lambda t: _parsed(combined_lines(t["logs"]), "combined").select(*_NAMES, "micros", "referrer", "user_agent", "extra_json"), f"SELECT {_COLUMNS}, {_SECOND} AS micros, referrer, user_agent, CAST(NULL AS VARCHAR) AS extra_json FROM logs")
add(
    "parse_errors_by_code",
    lambda t: parse.parse(common_lines(t["logs"], True), formats.preset("common")).groupBy("kind", "code", "field").agg(F.count("*").alias("n")),
    "SELECT CASE WHEN k BETWEEN 1 AND 5 THEN 'error' ELSE 'record' END AS kind, CASE k "
    + " ".join(f"WHEN {k} THEN '{c}'" for k, (c, _) in _SPOILED.items()) + " END AS code, CASE k " + " ".join(f"WHEN {k} THEN '{f}'" for k, (_, f) in _SPOILED.items() if f)
    + f" END AS field, count(*) AS n FROM (SELECT line_number % 10 AS k FROM logs) GROUP BY 1, 2, 3",
)
add("match_rate", lambda t: parse.match_rate(parse.parse(common_lines(t["logs"], True), formats.preset("common"))), f"SELECT source_id, count(*) FILTER (line_number % 10 NOT BETWEEN 1 AND 5) AS records, count(*) FILTER (line_number % 10 BETWEEN 1 AND 5) AS errors, CAST(0 AS BIGINT) AS skipped, count(*) FILTER (line_number % 10 NOT BETWEEN 1 AND 5) / CAST(count(*) AS DOUBLE) AS match_rate FROM logs GROUP BY source_id")
add("detect_best_profile", lambda t: lines.detect(combined_lines(t["logs"]), rows=10**9).select("source_id", "candidate", "records"), f"SELECT source_id, 'combined' AS candidate, count(*) AS records FROM logs GROUP BY source_id")
add(
    "parse_w3c_ffill",
    lambda t: _parsed(w3c_lines(t["logs"]), "w3c").select("source_id", "line_number", "client_ip", "method", "request_target", "status", "bytes_sent", "micros"),
    f"SELECT source_id, line_number + CASE WHEN line_number > 500 THEN 1 ELSE 0 END AS line_number, client_ip, CASE WHEN line_number <= 500 THEN method END AS method, request_target, CASE WHEN line_number <= 500 THEN status END AS status, CASE WHEN line_number > 500 THEN bytes_sent END AS bytes_sent, {_SECOND} AS micros FROM logs",
)
add("parse_request_line", lambda t: kept(t, ALL).select(*KEY, *[c.alias(n) for c, n in zip(parse.request_parts(F.concat_ws(" ", "method", "request_target", "protocol")), ("m", "t", "p"), strict=True)]), f"SELECT {', '.join(KEY)}, method AS m, request_target AS t, protocol AS p {_A}")
add("parse_tz_policy", lambda t: t["logs"].where("timestamp_utc is not null").select(*KEY, parse.timestamp(clf_time(), {"kind": "clf"}, {"kind": "fixed", "offset_seconds": 32_400})[0].alias("micros")), f"SELECT {', '.join(KEY)}, {_SECOND} - 32400000000 AS micros FROM logs WHERE timestamp_utc IS NOT NULL")
_DASH = lambda c: f"coalesce(CAST({c} AS VARCHAR), '-')"
_REQUEST = f"CASE WHEN method IS NULL AND request_target IS NULL AND protocol IS NULL THEN '-' ELSE {_DASH('method')} || ' ' || {_DASH('request_target')} || ' ' || {_DASH('protocol')} END"
add(
    "reconstruct_combined",
    lambda t: t["logs"].select(*KEY, reconstruct.combined_like().alias("text")),
    f"SELECT {', '.join(KEY)}, {_DASH('client_ip')} || ' - - [' || coalesce({_CLF_SQL} || ' +0000', '-') || '] \"' || {_REQUEST} || '\" ' || {_DASH('status')} || ' ' || {_DASH('bytes_sent')} || ' \"' || {_DASH('referrer')} || '\" \"' || {_DASH('user_agent')} || '\"' AS text FROM logs",
)
add("job_counters", lambda t: paging.batches_of_jobs(t["logs"]).select("job_id", "batches", "records"), "SELECT job_id, count(DISTINCT batch_id) AS batches, count(*) AS records FROM logs GROUP BY job_id")
add("export_json_lines", lambda t: exporting.json_lines(kept(t, ERRORS)).select("source_id", "line_number", F.get_json_object("line", "$.extra.message").alias("message"), F.get_json_object("line", "$.timestamp_utc").alias("time"), F.get_json_object("line", "$.method").alias("method")), f"SELECT source_id, line_number, {_MESSAGE} AS message, nullif({_ISO}, '') AS time, method {_E}")
add("url_decoded", lambda t: kept(t, ALL).select(*KEY, display.url_decoded(F.col("request_target")).alias("text")), f"SELECT {', '.join(KEY)}, replace(replace(request_target, '%27', ''''), '%20', ' ') AS text {_A}")
_UNITS = " ".join(f"WHEN bytes_sent < {1024 ** (k + 1)} THEN CASE WHEN bytes_sent / {1024.0**k} >= 100 THEN CAST(CAST(floor(bytes_sent / {1024.0**k} + 0.5) AS BIGINT) AS VARCHAR) ELSE printf('%.1f', floor(bytes_sent / {1024.0**k} * 10 + 0.5) / 10) END || ' {u}'" for k, u in ((1, "KiB"), (2, "MiB"), (3, "GiB")))
_BYTES = f"CASE WHEN bytes_sent IS NULL THEN '–' WHEN bytes_sent < 1024 THEN CAST(bytes_sent AS VARCHAR) || ' B' {_UNITS} END"
add(
    "iso_and_offset",
    lambda t: t["logs"].select(*KEY, display.iso_utc(F.col("timestamp_utc")).alias("iso"), display.offset_text(F.col("tz_offset_seconds") - 19_800).alias("zone"), display.time_text(F.col("timestamp_utc")).alias("shown"), display.bytes_text(F.col("bytes_sent")).alias("size")),
    f"SELECT {', '.join(KEY)}, {_ISO} AS iso, CASE WHEN tz_offset_seconds IS NOT NULL THEN 'UTC-05:30' ELSE '미확정' END AS zone, coalesce(strftime(timestamp_utc + INTERVAL 9 HOURS, '%Y-%m-%d %H:%M:%S'), '(시간 미확정)') AS shown, {_BYTES} AS size FROM logs",
)
add("bytes_text_cases", lambda t: t["logs"].select(*KEY, display.bytes_text(F.col("bytes_sent") * F.col("line_number")).alias("size")), f"SELECT {', '.join(KEY)}, {_BYTES} AS size FROM (SELECT * REPLACE (bytes_sent * line_number AS bytes_sent) FROM logs)")


# --- the way through files: the demo rows as log files, imported by ranges and committed, and read back ---


def imported(t: DataFrame, profile: str) -> Store:
    """A new store below the shared folder that has imported ``t`` (value), written as several files."""
    spark = t.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tallylog-")
    root = f"{shared.rstrip('/')}/tallylog-case-{uuid.uuid4().hex}"
    t.repartition(3).select("value").write.option("lineSep", "\n").text(f"{root}/raw")
    store = Store(spark, f"{root}/case")
    own = formats.preset(profile)
    raw = storage.storage(spark, f"{root}/raw")
    paths = [f"{raw.url}/{n}" for n in raw.names("") if n.startswith("part-")]
    store.run(store.create_job(store.upsert_profile(own), store.register_sources(paths)), own, batch_rows=20_000)
    return store


def _sums(t: dict[str, DataFrame]) -> DataFrame:
    """Batches of an import: their lines, and what became of them."""
    batches = imported(common_lines(t["logs"], True), "common").batches()
    whole = F.sum(F.col("end_line") - F.col("start_line") + 1).alias("lines")
    return batches.agg(whole, *[F.sum(f"{k}_count").alias(k) for k in ("record", "error", "skipped")], F.count_if(F.col("next_offset").isNull()).alias("without_place"))


add("import_line_sums", _sums, "SELECT count(*) AS lines, count(*) FILTER (line_number % 10 NOT BETWEEN 1 AND 5) AS record, count(*) FILTER (line_number % 10 BETWEEN 1 AND 5) AS error, 0 AS skipped, 0 AS without_place FROM logs")
add(
    "import_rows",
    lambda t: imported(combined_lines(t["logs"]), "combined").logs().groupBy("status", "method").agg(F.count("*").alias("n"), F.sum("bytes_sent").alias("bytes"), F.sum(F.unix_micros("timestamp_utc") % 1_000_000_007).alias("times"), F.countDistinct("source_id", "line_number").alias("places")),
    f"SELECT status, method, count(*) AS n, sum(bytes_sent) AS bytes, sum({_SECOND} % 1000000007) AS times, count(*) AS places FROM logs GROUP BY status, method",
)
add(
    "import_errors",
    lambda t: imported(common_lines(t["logs"], True), "common").parse_errors().groupBy("error_code", "field_name").agg(F.count("*").alias("n")),
    "SELECT CASE k " + " ".join(f"WHEN {k} THEN '{c}'" for k, (c, _) in _SPOILED.items()) + " END AS error_code, CASE k " + " ".join(f"WHEN {k} THEN '{f}'" for k, (_, f) in _SPOILED.items() if f)
    + " END AS field_name, count(*) AS n FROM (SELECT line_number % 10 AS k FROM logs) WHERE k BETWEEN 1 AND 5 GROUP BY 1, 2",
)


def _first_pages(t: dict[str, DataFrame]) -> DataFrame:
    """Times of the first three pages of an imported store, from the files that can have them."""
    store, cursor, rows = imported(combined_lines(t["logs"]), "combined"), None, []
    for _ in range(3):
        page = store.page(LogFilter(status=404), 100, True, cursor)
        rows += [(r["_micros"], r["status"]) for r in page.rows]
        if (cursor := page.cursor) is None:
            break
    return t["logs"].sparkSession.createDataFrame(rows, "micros long, status int")


add("import_first_pages", _first_pages, f"SELECT {_SECOND} AS micros, status FROM logs WHERE status = 404 ORDER BY micros DESC NULLS LAST LIMIT 300")
