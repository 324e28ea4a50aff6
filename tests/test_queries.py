"""The registered queries against DuckDB on the same tables, and the rules around them."""

import duckdb
import pytest

from tallylog import catalog
from tallylog.functions.regex_dialect import PatternError, to_java
from tallylog.operators import filters, paging, rules, stats
from tallylog.operators.filters import And, Cond, LogFilter, Not, Or
from tallylog.plans import demo_logs

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in ("events", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_same_rows_as_duckdb(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    names = sorted(got.columns)
    want = duck.execute(catalog.ORACLE[name])
    at = [[d[0] for d in want.description].index(n) for n in names]
    assert sorted(repr(tuple(r[n] for n in names)) for r in got.collect()) == sorted(repr(tuple(r[k] for k in at)) for r in want.fetchall())


@pytest.mark.parametrize("descending", [False, True])
def test_pages_follow_each_other(spark, descending):
    t = demo_logs.tables(spark, DATA)
    f = LogFilter(active_only=True, log_kind="access")
    want = filters.apply_filter(t["logs"], f, t["jobs"]).orderBy(*paging.page_order(descending)).select("source_id", "line_number").collect()
    got, cursor = [], None
    while True:
        page = paging.fetch_page(t["logs"], f, t["jobs"], t["bookmarks"], 200, descending, cursor)
        got += [(r.source_id, r.line_number) for r in page.rows]
        cursor = page.cursor
        if cursor is None:
            break
    assert got == [tuple(r) for r in want]
    with pytest.raises(filters.FilterError):
        paging.page_plan(t["logs"], LogFilter(status=1), t["jobs"], t["bookmarks"], 10, descending, paging.Cursor("x", descending, 1, None, 1, 1))


@pytest.mark.parametrize(("pattern", "text", "hit"), [("a$", "a\n", False), (r"(?i)É", "é", True), (r"\s", "\x0b", False), (".", "\r", True), (r"é\b", "é", False), (r"x\b", "x", True), ("[a&&b]", "&", True), ("[[]", "[", True), ("(?P<a_b>x)", "x", True)])
def test_patterns_mean_the_same(spark, pattern, text, hit):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.lit(text).rlike(to_java(pattern))).first()[0] is hit


@pytest.mark.parametrize("pattern", ["(?=a)", "(?<!a)", "(?>a)", r"(a)\1", "a++"])
def test_patterns_outside_the_dialect(pattern):
    with pytest.raises(PatternError):
        to_java(pattern)


def test_rules():
    rule = rules.parse_rule('rule a { strings: $x = "Q" nocase $y1 = /z+/i // note\n condition: not ua is empty and any of ($y*) or status in (1, 2) }')
    assert rule.expr == Or((And((Not(Cond("user_agent", "is_null")), Or((Cond("request_target", "regex", "(?i)z+"),)))), Or((Cond("status", "eq", "1"), Cond("status", "eq", "2")))))
    assert rules.parse_rule("rule e { condition: level == \"x\" }", "error").expr == Cond("level", "eq", "x")
    for bad in ("", "rule a { }", "rule a { condition: nope == 1 }", 'rule a { condition: status contains "x" }', "rule a { strings: $a = /(?=x)/ condition: $a }", "rule a { condition: any of ($q*) }", 'rule a { condition: path > "x" }'):
        with pytest.raises(rules.RuleError):
            rules.parse_rule(bad)


def test_guards():
    deep = Cond("status", "eq", "1")
    for _ in range(20):
        deep = Not(deep)
    for bad in (deep, And(tuple(Cond("status", "eq", "1") for _ in range(300))), Cond("status", "eq", "x"), Cond("method", "eq", "é" * 600), Cond("status", "contains", "1")):
        with pytest.raises(filters.FilterError):
            filters.expr_column(bad)


def test_auto_buckets():
    assert [stats.auto_bucket(0, s * 1_000_000) for s in (60, 30 * 86_400, 3 * 365 * 86_400)] == [60, 21_600, 604_800]


def test_filters_on_one_line():
    f = LogFilter(status=404, status_class=4, method="GET", target_contains="a", expr=Cond("status", "eq", "1"), time_from=1, job_id=7)
    assert rules.describe_filter(f) == '상태 404 · 메서드 GET · 경로에 "a" 포함 · status eq 1 · 시간 범위 · 작업 7'
    assert rules.describe_filter(LogFilter()) == "조건 없음" and rules.describe_filter(LogFilter(status_class=5, client_ip="::1", target_regex="x")) == "상태 5xx · IP ::1 · 경로 정규식"


@pytest.mark.parametrize(("kind", "bucket", "offset"), [("access", "auto", 0), ("access", "hour", 19_800), ("error", 77, 0), (None, "auto", 61)])
def test_statistics_of_one_scan(spark, kind, bucket, offset):
    """All at once they are what each is by itself."""
    t = demo_logs.tables(spark, DATA)
    logs = filters.apply_filter(t["logs"], LogFilter(active_only=True, log_kind=kind), t["jobs"])
    got = stats.compute(logs, kind, 7, bucket, offset)
    span = stats.totals(logs).first()
    size = stats.NAMED.get(bucket, bucket) if bucket != "auto" else stats.auto_bucket(span.first_micros, span.last_micros)
    want = {"totals": stats.totals(logs), "top_ips": stats.top_ips(logs, 7), "ip_rows": stats.ip_rows(logs, 7), "timeline": stats.timeline(logs, size, offset)}
    want |= {"levels": stats.by_level(logs), "top_messages": stats.top_messages(logs, 7)} if kind == "error" else {"status": stats.by_status(logs), "methods": stats.by_method(logs), "top_targets": stats.top_targets(logs, 7)}
    for name, frame in want.items():
        assert list(map(tuple, got[name].collect())) == list(map(tuple, frame.collect())), name
    assert set(got) - set(want) == {"truncated", "table"}
    assert str(got["table"]._jdf.queryExecution().optimizedPlan()).count("InMemoryRelation") == 1
    got["table"].unpersist()


def test_protocol_cases_has_every_protocol(spark):
    """Its SQL once had rows of two protocols only."""
    kinds = ("TLS ClientHello", "TLS 1.0", "TLS 1.1", "TLS 1.2+", "SSLv2", "SOCKS5", "SOCKS4", "길이 접두")
    told = {r.text for r in catalog.QUERIES["protocol_cases"](spark, DATA).select("text").distinct().collect()}
    assert None in told and all(any(t and t.startswith(k) for t in told) for k in kinds)


def test_logs_are_joined_with_their_pages_in_every_task(spark):
    """Not by the fifty values of a key, however large the tables are said to be."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = str(demo_logs.tables(spark, DATA)["logs"]._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
