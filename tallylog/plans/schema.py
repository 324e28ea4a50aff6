"""Tables, enumerations and limits of the log store."""

from __future__ import annotations

from pyspark.sql import types as T


def _table(text: str) -> T.StructType:
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "bool": T.BooleanType(), "time": T.TimestampType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in text.split())])


LOGS = _table(
    "job_id:long source_id:long batch_id:long line_number:long timestamp_utc:time tz_offset_seconds:int client_ip:string method:string request_target:string "
    "protocol:string status:int bytes_sent:long referrer:string user_agent:string extra_json:string"
)
PARSE_ERRORS = _table("job_id:long source_id:long batch_id:long line_number:long error_code:string field_name:string")
IMPORT_BATCHES = _table(
    "batch_id:long job_id:long source_id:long batch_seq:int start_offset:long next_offset:long start_line:long end_line:long header_state_json:string "
    "record_count:int error_count:int skipped_count:int committed_at:time"
)
IMPORT_JOBS = _table(
    "job_id:long result_version:long status:string profile_id:long started_at:time finished_at:time committed_records:long committed_errors:long "
    "committed_skipped:long failure_reason:string active:bool replaces_job_id:long log_kind:string"
)
IMPORT_JOB_SOURCES = _table("job_id:long source_id:long ordinal:int status:string")
#: the layout of a store's folder
STORE_VERSION = 3
SOURCES = _table(
    "source_id:long original_path:string current_path:string file_size:long modified_unix:long encoding:string compression:string head_hash:string head_bytes:long "
    "registered_at:time full_hash:string"
)
PARSER_PROFILES = _table("profile_id:long name:string version:int definition_json:string definition_hash:string")
SAVED_VIEWS = _table("view_id:long name:string definition_json:string")
BOOKMARKS = _table("source_id:long line_number:long created_at:time")

#: fixed values: enumerations of the stored data
LOG_KINDS = ("access", "error")
JOB_STATUSES = ("queued", "running", "completed", "completed_with_errors", "cancelling", "cancelled", "failed", "interrupted")
RESUMABLE = ("interrupted", "cancelled", "failed")
ERROR_CODES = (
    "no_match", "invalid_utf8", "line_too_long", "invalid_ip", "invalid_timestamp", "invalid_integer", "invalid_status", "header_missing",
    "field_count_mismatch", "invalid_directive",
)
SKIP_REASONS = ("blank", "directive", "continuation")

#: fixed values: limits
PAGE_ROWS, PAGE_BYTES, EXPORT_PAGE_ROWS = 1000, 4 << 20, 20_000
VALUE_BYTES, EXPR_NODES, EXPR_DEPTH = 1024, 256, 16
TOP_N, BUCKETS, AUTO_BUCKETS, TZ_OFFSET = 100, 2000, 400, 64_800
LINE_BYTES, BATCH_ROWS, BATCH_ERRORS = 64 << 10, 100_000, 100_000
PATTERN_BYTES, NESTING, BLOCKS, NAME_CHARS = 16 << 10, 8, 256, 64
W3C_FIELDS, YAML_BYTES, SCAN_ENTRIES, VIEW_NAME_BYTES = 256, 256 << 10, 100_000, 64
SAMPLE_LINES, SAMPLE_BYTES, DETECT_LINES = 20, 256 << 10, 200
