"""Log tables over the test data: ``events`` and ``pages`` seen as parsed access and error logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: one text for both engines
LOGS_SQL = """
SELECT CAST(CASE WHEN e.event_type = 'error' THEN 3 WHEN e.event_id % 5 = 0 THEN 2 ELSE 1 END AS BIGINT) AS job_id,
       CAST(CASE WHEN e.event_type = 'error' THEN 2 ELSE 1 END AS BIGINT) AS source_id,
       CAST(FLOOR(e.event_id / 1000.0) + 1 AS BIGINT) AS batch_id,
       CAST(e.event_id + 1 AS BIGINT) AS line_number,
       CASE WHEN e.event_id % 97 = 0 THEN NULL ELSE CAST(e.ts AS TIMESTAMP) END AS timestamp_utc,
       CASE WHEN e.event_id % 97 = 0 THEN NULL ELSE 0 END AS tz_offset_seconds,
       CASE WHEN e.event_id % 53 = 0 THEN NULL
            ELSE concat('10.0.', CAST(e.user_id % 4 AS STRING), '.', CAST(e.user_id % 251 AS STRING)) END AS client_ip,
       CASE WHEN e.event_type = 'error' THEN NULL WHEN e.event_type = 'purchase' THEN 'POST'
            WHEN e.event_type = 'signup' THEN 'PUT' WHEN e.event_type = 'click' THEN 'HEAD' ELSE 'GET' END AS method,
       CASE WHEN e.event_type = 'error' THEN NULL
            WHEN e.event_id % 41 = 0 THEN '/item?id=1%27%20UNION%20ALL%20SELECT%20NULL'
            WHEN e.event_id % 43 = 0 THEN '/get?f=../../etc/passwd'
            WHEN e.event_id % 47 = 0 THEN '/s?q=<script>alert(1)</script>'
            WHEN e.event_id % 11 = 0 THEN '/static/app.js?v=2'
            ELSE concat('/', split_part(p.url, '/', 4), '/', split_part(p.url, '/', 5)) END AS request_target,
       CASE WHEN e.event_type = 'error' THEN NULL ELSE 'HTTP/1.1' END AS protocol,
       CASE WHEN e.event_type = 'error' THEN NULL WHEN e.event_id % 29 = 0 THEN NULL
            WHEN e.event_id % 20 = 0 THEN 500 WHEN e.event_id % 13 = 0 THEN 404 WHEN e.event_id % 7 = 0 THEN 301 ELSE 200 END AS status,
       CASE WHEN e.event_type = 'error' OR e.event_id % 31 = 0 THEN NULL ELSE CAST(FLOOR(e.value * 100) AS BIGINT) END AS bytes_sent,
       CASE WHEN e.event_id % 3 = 0 AND e.event_type <> 'error' THEN p.url ELSE NULL END AS referrer,
       CASE WHEN e.event_type = 'error' THEN NULL WHEN e.user_id % 6 = 0 THEN 'curl/8.6.0' WHEN e.user_id % 6 = 1 THEN 'sqlmap/1.7'
            WHEN e.user_id % 6 = 2 THEN NULL WHEN e.user_id % 6 = 3 THEN 'Nikto/2.5' ELSE 'Mozilla/5.0' END AS user_agent,
       CASE WHEN e.event_type <> 'error' THEN NULL
            WHEN e.event_id % 9 = 0 THEN '{"message":"signal process started"}'
            WHEN e.event_id % 4 = 0 THEN '{"level":"crit","message":"SSL_do_handshake() failed"}'
            WHEN e.event_id % 4 = 1 THEN '{"level":"error","message":"connect() failed (111: Connection refused)"}'
            WHEN e.event_id % 4 = 2 THEN '{"level":"core:error","message":"AH00035: File does not exist"}'
            ELSE '{"level":"warn","message":"upstream sent too big header"}' END AS extra_json
FROM events e LEFT JOIN pages p ON p.page_id = e.event_id % 50
"""
JOBS_SQL = "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'completed', true, 'access'), (CAST(2 AS BIGINT), 'completed', false, NULL), (CAST(3 AS BIGINT), 'completed_with_errors', true, 'error')) AS t(job_id, status, active, log_kind)"
SOURCES_SQL = "SELECT * FROM (VALUES (CAST(1 AS BIGINT), '/logs/access.log', '/logs/access.log'), (CAST(2 AS BIGINT), '/logs/error.log', '/moved/error.log')) AS t(source_id, original_path, current_path)"
BOOKMARKS_SQL = "SELECT CAST(CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS BIGINT) AS source_id, CAST(event_id + 1 AS BIGINT) AS line_number FROM events WHERE event_id % 101 = 0"


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """logs, jobs, sources and bookmarks; nothing is registered in the session's catalog."""
    events, pages = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "pages"))
    # the statement joins by event_id % 50: of the key of ``pages`` only these can meet, and 50 values make no join of many tasks
    met = F.broadcast(pages.where(F.col("page_id").between(-49, 49)))
    logs = _bound(spark, LOGS_SQL, events, met)
    return {"logs": logs, "jobs": spark.sql(JOBS_SQL), "sources": spark.sql(SOURCES_SQL), "bookmarks": _bound(spark, BOOKMARKS_SQL, events, pages)}


def _bound(spark: SparkSession, text: str, events: DataFrame, pages: DataFrame) -> DataFrame:
    """The statement over these frames, by views of names of their own that live as long as the call."""
    names = {"events": events, "pages": pages}
    own = {}
    for name, frame in names.items():
        own[name] = f"_tallylog_{name}_{id(frame)}"
        frame.createOrReplaceTempView(own[name])
    found = spark.sql(text.replace("FROM events", f"FROM {own['events']}").replace("JOIN pages", f"JOIN {own['pages']}"))
    found.schema  # noqa: B018  resolves the plan before the views go
    for view in own.values():
        spark.catalog.dropTempView(view)
    return found
