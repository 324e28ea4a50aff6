"""Lines to outcomes: record, error or skipped, all in Columns.

The session's time zone has to be UTC.  A line's expression is evaluated once: the match is
rewritten to its groups with a separator between them, and split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallylog.plans.schema import LINE_BYTES, W3C_FIELDS
from tallylog.sources.formats import FieldDef, compile_blocks

RECORD = "struct<timestamp_utc: timestamp, tz_offset_seconds: int, client_ip: string, method: string, request_target: string, protocol: string, status: int, bytes_sent: bigint, referrer: string, user_agent: string, extra: map<string,string>>"
RECORD_NAMES = tuple(x.split(": ")[0] for x in RECORD[len("struct<") : -1].split(", ") if not x.startswith("extra"))
#: columns of lines that outcomes keep
PLACES = ("start_offset", "next_offset", "header")
#: W3C directives that a broadcast may hold, and their bytes; where they are more, the lines that share one lookup
HEADS, HEAD_BYTES, RUN = 4096, 4 << 20, 1 << 16
_BREAK = ""
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IP4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_HEX = "[0-9A-Fa-f]{1,4}"
_BLANK = r"^\p{IsWhite_Space}*$"


def _ip6() -> str:
    """All forms of an IPv6 address: groups around one gap at most, the last two as an IPv4 address or not."""
    tail = f"(?:{_HEX}:{_HEX}|{_IP4})"
    forms = [f"(?:{_HEX}:){{6}}{tail}"]
    for before in range(7):
        head = f"(?:{_HEX}(?::{_HEX}){{0,{before - 1}}})?" if before else ""
        room = 5 - before
        rest = [f"(?:{_HEX}:){{0,{room}}}{tail}"] if room >= 0 else []
        forms.append(f"{head}::(?:{'|'.join([*rest, _HEX, ''])})")
    forms.append(f"(?:{_HEX}:){{1,7}}:|::")
    return "|".join(f"(?:{f})" for f in forms)


_IP, _ONLY_IP4 = rf"\A(?:{_IP4}|{_ip6()})\z", rf"\A{_IP4}\z"
_CLF = r"\A[0-9]{2}/(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)/[0-9]{4}:[0-9]{2}:[0-9]{2}:[0-9]{2} [+-][0-9]{4}\z"


def is_ip(text: Column) -> Column:
    colons = F.length(text) - F.length(F.replace(text, F.lit(":"), F.lit("")))
    # the long pattern only for what the short one leaves
    return F.when(text.rlike(_ONLY_IP4), True).when(~text.contains(":"), False).otherwise(text.rlike(_IP) & (colons <= 8))


def is_blank(text: Column) -> Column:
    """Only white space of any script; most lines show by their first character that they are not."""
    return F.when(F.ascii(text).between(33, 126), False).otherwise(text.rlike(_BLANK))


def integer(text: Column) -> Column:
    return F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("bigint"))


def status(text: Column) -> Column:
    number = F.when(text.rlike(r"\A\+?[0-9]+\z"), text.try_cast("int"))
    return F.when(number.between(100, 599), number)


def offset_seconds(text: Column) -> Column:
    """``+09:00``, ``-0700`` or ``Z`` in seconds."""
    sign = F.when(text.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.when(F.upper(text) == "Z", 0).otherwise(sign * (F.substring(digits, 1, 2).try_cast("int") * 3600 + F.substring(digits, 3, 2).try_cast("int") * 60))


def strftime_parts(pattern: str) -> tuple[str, bool]:
    """(pattern for Spark, whether an offset ends the text); weekdays go."""
    names = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "b": "MMM", "h": "MMM", "B": "MMMM", "y": "yy", "e": "d", "I": "hh", "p": "a", "j": "DDD", "T": "HH:mm:ss", "F": "yyyy-MM-dd", "D": "MM/dd/yy", "R": "HH:mm", "a": "", "A": "", "z": "", "f": "SSSSSS"}
    out, k, zone = [], 0, False
    while k < len(pattern):
        c = pattern[k]
        if c == "%":
            k += 1
            if pattern[k] in ":.":
                k += 1
                if pattern[k] == "f":
                    out.append("[.SSSSSS][.SSS]")
                    k += 1
                    continue
            if pattern[k] not in names:
                raise ValueError("a part of the time format isn't supported")
            zone |= pattern[k] == "z"
            out.append(names[pattern[k]])
        else:
            out.append(f"'{c}'" if c.isalpha() else c)
        k += 1
    return "".join(out).strip(" ,"), zone


def clf_parts(text: Column) -> tuple[Column, Column]:
    """(microseconds of the clock, offset) of a text of the usual shape, by its places; no time where a part is out of range."""
    number = lambda first, size: F.substring(text, first, size).cast("int")
    month = ((F.instr(F.lit("JanFebMarAprMayJunJulAugSepOctNovDec"), F.substring(text, 4, 3)) + 2) / 3).cast("int")
    day = F.try_make_timestamp(number(8, 4), month, number(1, 2), number(13, 2), number(16, 2), number(19, 2).cast("decimal(8,6)"))
    sign = F.when(F.substring(text, 22, 1) == "-", -1).otherwise(1)
    # second 60 would be taken as the next minute
    return F.when(number(19, 2) < 60, F.unix_micros(day)), sign * (number(23, 2) * 3600 + number(25, 2) * 60)


def timestamp(text: Column, form: dict, zone: dict) -> tuple[Column, Column, Column]:
    """(microseconds, offset, whether the text is a time); the policy stands in for an offset that isn't there."""
    if form["kind"] == "clf":
        usual = text.rlike(_CLF)
        clock, given = clf_parts(text)
        micros, offset, ok = _timestamp(text, form, zone)
        return F.when(usual, clock - given.cast("bigint") * 1_000_000).otherwise(micros), F.when(usual, given).otherwise(offset), F.when(usual, clock.isNotNull()).otherwise(ok)
    return _timestamp(text, form, zone)


def _timestamp(text: Column, form: dict, zone: dict) -> tuple[Column, Column, Column]:
    """``timestamp`` by patterns, for texts of any shape."""
    if form["kind"] == "clf":
        shape = r"\A([0-9]{1,2}/[A-Za-z]{3}/[0-9]{4}:[0-9]{2}:[0-9]{2}:[0-9]{2})(?: ([+-][0-9]{2}:?[0-9]{2}))?\z"
        naive = F.try_to_timestamp(F.regexp_extract(text, shape, 1), F.lit("d/MMM/yyyy:HH:mm:ss"))
        own = F.regexp_extract(text, shape, 2)
    elif form["kind"] == "iso8601":
        shape = r"\A([0-9]{4}-[0-9]{2}-[0-9]{2})[Tt ]([0-9]{2}:[0-9]{2}:[0-9]{2})(?:\.([0-9]+))?([Zz]|[+-][0-9]{2}:[0-9]{2})?\z"
        part = F.rpad(F.regexp_extract(text, shape, 3), 6, "0")
        naive = F.when(text.rlike(shape), F.try_to_timestamp(F.concat(F.regexp_extract(text, shape, 1), F.lit(" "), F.regexp_extract(text, shape, 2), F.lit("."), part), F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")))
        own = F.regexp_extract(text, shape, 4)
    else:
        pattern, has_zone = strftime_parts(form["pattern"])
        plain = F.regexp_replace(text, r"(?i)\b(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*[ ,]*", "") if "%a" in form["pattern"].lower() else text
        own = F.regexp_extract(plain, r"([+-][0-9]{2}:?[0-9]{2}|Z)\z", 1) if has_zone else F.lit("")
        naive = F.try_to_timestamp(F.trim(F.regexp_replace(plain, r"\s*(?:[+-][0-9]{2}:?[0-9]{2}|Z)\z", "") if has_zone else plain), F.lit(pattern))
        if has_zone:
            naive = F.when(own != "", naive)
    fallback = {"from_input": F.lit(None).cast("int"), "utc": F.lit(0)}.get(zone["kind"], F.lit(zone.get("offset_seconds", 0)))
    offset = F.when(own != "", offset_seconds(own)).otherwise(fallback)
    micros = F.unix_micros(naive) - offset.cast("bigint") * 1_000_000
    return micros, offset, naive.isNotNull()


def request_parts(raw: Column) -> tuple[Column, Column, Column]:
    """Method, target and protocol; what isn't a request is a target as a whole.

    The method is the first word; the protocol is the last one if it begins like one and a
    target's place is left before it.
    """
    method = F.substring_index(raw, " ", 1)
    named = method.rlike(r"\A[A-Z_-]+\z")
    whole, alone = named & raw.contains(" "), named & ~raw.contains(" ")
    rest = F.substring(raw, F.length(method) + 2, F.length(raw))
    last = F.substring_index(rest, " ", -1)
    ends = rest.contains(" ") & last.startswith("HTTP/")
    target = F.when(ends, F.substring(rest, F.lit(1), F.length(rest) - F.length(last) - 1)).otherwise(rest)
    some = lambda x: F.nullif(x, F.lit(""))
    return F.when(whole | alone, method), F.when(whole, some(target)).when(~alone, raw), F.when(whole & ends, last)


def _error(code: str, field: str | None = None) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(field).cast("string").alias("field"))


def _record(values: dict[str, Column], extra: Column) -> Column:
    kinds = [x.split(": ") for x in RECORD[len("struct<") : -1].split(", ")]
    return F.struct(*[(values.get(n, F.lit(None)) if n != "extra" else extra).cast(k).alias(n) for n, k in kinds])


def _fields(parts: Column, fields: list[FieldDef], zone: dict) -> tuple[dict[str, Column], dict[str, Column], list[Column]]:
    """(record columns, extra values, errors in order) of the matched groups."""
    record, extra, errors = {}, {}, []
    for f in fields:
        there = F.lit(True)
        for g in f.within:
            there = there & (F.get(parts, F.lit(g - 1)) != "")
        raw = F.when(there, F.get(parts, F.lit(f.group - 1)))
        if f.missing:
            raw = F.when(~raw.isin(f.missing), raw)
        match f.kind:
            case "client_ip":
                record["client_ip"] = raw
                errors.append(F.when(raw.isNotNull() & ~is_ip(raw), _error("invalid_ip", f.name)))
            case "timestamp":
                micros, offset, ok = timestamp(raw, f.format or {"kind": "clf"}, zone)
                record["timestamp_utc"], record["tz_offset_seconds"] = F.timestamp_micros(micros), F.when(ok, offset)
                errors.append(F.when(raw.isNotNull() & ~ok, _error("invalid_timestamp", f.name)))
            case "request_line":
                record["method"], record["request_target"], record["protocol"] = request_parts(raw)
            case "status" | "bytes_sent" | "integer":
                number = status(raw) if f.kind == "status" else integer(raw)
                errors.append(F.when(raw.isNotNull() & number.isNull(), _error("invalid_status" if f.kind == "status" else "invalid_integer", f.name)))
                if f.kind == "integer":
                    extra[f.name] = number.cast("string")
                else:
                    record[f.kind] = number
            case "text":
                extra[f.name] = raw
            case kind:
                record[kind] = raw
    return record, extra, errors


def extra_map(values: dict[str, Column]) -> Column:
    """The values that are there, by name in order; null if there are none."""
    if not values:
        return F.lit(None).cast("map<string,string>")
    pairs = F.filter(F.array(*[F.struct(F.lit(n).alias("k"), v.cast("string").alias("v")) for n, v in sorted(values.items())]), lambda p: p["v"].isNotNull())
    return F.when(F.size(pairs) > 0, F.map_from_entries(pairs))


def extra_json(extra: Column) -> Column:
    return F.when(F.size(extra) > 0, F.to_json(F.map_from_entries(F.array_sort(F.map_entries(extra)))))


def _prepared(lines: DataFrame, limit: int) -> DataFrame:
    """``lines`` with text, one trailing CR dropped, and what is wrong with the bytes."""
    bad = F.when(F.octet_length("value") > limit, _error("line_too_long")).when(~F.is_valid_utf8("value"), _error("invalid_utf8"))
    return lines.withColumns({"_bad": bad, "_text": F.when(F.octet_length("value") <= limit, F.when(F.col("value").endswith("\r"), F.substring(F.col("value"), F.lit(1), F.length("value") - 1)).otherwise(F.col("value")))})


def parse(lines: DataFrame, profile: dict, limit: int = LINE_BYTES) -> DataFrame:
    """``lines`` (source_id, line_number, value) as (source_id, line_number, kind, record, code, field, reason)."""
    w3c = profile["strategy"]["kind"] == "w3c"
    if w3c and "header" not in lines.columns:
        lines = with_headers(lines)
    ready = _prepared(lines, limit)
    ready = _w3c(ready, profile) if w3c else _blocks(ready, profile)
    ready = _settled(ready, _found=F.struct("_bad", F.col("_reason").alias("reason"), F.col("_error").alias("error"), F.col("_record").alias("record")))
    skipped = F.when(F.col("_found._bad").isNull(), F.col("_found.reason"))
    error = F.coalesce("_found._bad", F.when(skipped.isNull(), F.col("_found.error")))
    return ready.select(
        "source_id", "line_number", F.when(error.isNotNull(), "error").when(skipped.isNotNull(), "skipped").otherwise("record").alias("kind"),
        F.when(error.isNull() & skipped.isNull(), F.col("_found.record")).alias("record"), error["code"].alias("code"), error["field"].alias("field"), skipped.alias("reason"),
        *[c for c in PLACES if c in lines.columns],
    )


def _settled(frame: DataFrame, **columns: Column) -> DataFrame:
    """``frame`` with columns that stay what they are.

    The optimizer replaces a column by its expression in filters above it, once for each
    mention; it doesn't look through a generator, here of one row a row.
    """
    for name, value in columns.items():
        frame = frame.select("*", F.explode(F.array(value)).alias(name))
    return frame


def _blocks(ready: DataFrame, profile: dict) -> DataFrame:
    made = compile_blocks(profile)
    text = F.col("_text")
    shape = _BREAK.join(f"${k}" for k in range(1, made.groups + 1)) + _BREAK
    ready = _settled(ready, _groups=F.regexp_replace(text, made.pattern, shape))
    # a text with the separator in it, which logs hardly have, is taken apart group by group
    slow = F.when(text.rlike(made.pattern), F.array(*[F.regexp_extract(text, made.pattern, k) for k in range(1, made.groups + 1)]))
    parts = F.when(text.contains(_BREAK), slow).when(F.col("_groups").endswith(_BREAK), F.split("_groups", _BREAK))
    ready = _settled(ready, _parts=parts)
    record, extra, errors = _fields(F.col("_parts"), made.fields, profile["timezone"])
    for name, group, within in made.extras:
        value = F.nullif(F.get("_parts", F.lit(group - 1)), F.lit(""))
        for g in within:
            value = F.when(F.get("_parts", F.lit(g - 1)) != "", value)
        extra[name] = value
    blank = is_blank(text)
    goes_on = F.regexp_replace(text, r"\p{IsWhite_Space}+\z", "").rlike(r"^(?:[ \t#]|at |Stack trace|thrown|Caused by|Traceback|\.\.\.)")
    none = F.col("_parts").isNull()
    return ready.withColumns({
        "_reason": F.when(blank, "blank").when(none & goes_on, "continuation"),
        "_error": F.when(none, _error("no_match")).otherwise(F.coalesce(*errors, F.lit(None))),
        "_record": _record(record, extra_map(extra)),
    })


#: fixed values: W3C columns that have a place in the record
_W3C = {"cs-method": "method", "cs-version": "protocol", "cs(Referer)": "referrer", "cs(User-Agent)": "user_agent"}
_W3C_OWN = (*_W3C, "c-ip", "cs-uri-stem", "cs-uri-query", "sc-status", "sc-bytes")
_W3C_READ = (*_W3C_OWN, "date", "time")


def with_headers(lines: DataFrame) -> DataFrame:
    """``lines`` with ``header``, the W3C columns that hold at each line, for readers that don't tell them.

    The directives, few a file, are gathered by one scan and broadcast; more than HEADS of
    them, or longer ones, are joined by file and run of lines, so that a large file is many keys.
    """
    names = F.filter(F.split(F.substring(F.regexp_replace("value", r"\r\z", ""), 9, LINE_BYTES), r"[ \t\r\n\f]+"), lambda x: x != "")
    told = F.col("value").startswith("#Fields:") & (F.octet_length("value") <= LINE_BYTES) & F.is_valid_utf8("value")
    heads = lines.where(told).select("source_id", "line_number", names.alias("names")).where(F.size("names").between(1, W3C_FIELDS))
    heads = heads.select("source_id", "line_number", F.array_join("names", " ").alias("names"))
    gathered = heads.limit(HEADS + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("names")), F.lit(0)).alias("size"), F.collect_list(F.struct("source_id", "line_number", "names")).alias("rows"))
    few = (F.col("n") <= HEADS) & (F.col("size") <= HEAD_BYTES)
    found = gathered.select(F.when(few, F.col("rows")).alias("rows")).first()["rows"]
    if found is None:
        return _many_headers(lines, heads)
    if not found:
        return lines.withColumn("header", F.lit(None).cast("string"))
    table = lines.sparkSession.createDataFrame([tuple(r) for r in found], heads.schema)
    own = table.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("line_number", "names"))).alias("_heads"))
    return _headed(lines.join(F.broadcast(own), "source_id", "left"))


def _headed(lines: DataFrame) -> DataFrame:
    """``header`` from the last of ``_heads`` that isn't below the line."""
    head = F.try_element_at(F.filter("_heads", lambda h: h["line_number"] <= F.col("line_number")), F.lit(-1))["names"]
    return lines.withColumn("header", head).drop("_heads")


def _many_headers(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """``with_headers`` for any number of directives: each run of lines has its own, and the last one before it."""
    run = F.floor(F.col("line_number") / RUN).alias("_run")
    own = heads.groupBy("source_id", run).agg(F.array_sort(F.collect_list(F.struct("line_number", "names"))).alias("_own"))
    before = Window.partitionBy("source_id").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = lines.select("source_id", run).distinct().join(own, ["source_id", "_run"], "left")
    carried = F.last(F.try_element_at("_own", F.lit(-1)), ignorenulls=True).over(before)
    runs = runs.select("source_id", "_run", F.concat(F.when(carried.isNull(), F.array()).otherwise(F.array(carried)), F.coalesce("_own", F.array())).alias("_heads"))
    return _headed(lines.withColumn("_run", run).join(runs, ["source_id", "_run"], "left").drop("_run"))


def _w3c(ready: DataFrame, profile: dict) -> DataFrame:
    """W3C extended logs: each ``#Fields:`` line names the columns of the lines after it, which are in ``header``."""
    text = F.col("_text")
    names = F.filter(F.split(F.substring(text, 9, LINE_BYTES), r"[ \t\r\n\f]+"), lambda x: x != "")
    directive = text.startswith("#Fields:")
    head = F.split("header", " ")
    ready = _settled(ready, **{"_names": head, "_tokens": F.filter(F.split(text, r"[ \t\r\n\f]+"), lambda x: x != "")})
    pairs = F.filter(F.arrays_zip(F.col("_names").alias("n"), F.col("_tokens").alias("v")), lambda p: p["v"] != "-")
    ready = _settled(ready, _pairs=F.when(F.size("_names") == F.size("_tokens"), F.transform(pairs, lambda p: F.struct(p["n"].alias("n"), p["v"].alias("v")))))
    last = lambda name: F.try_element_at(F.filter("_pairs", lambda p: p["n"] == name), F.lit(-1))["v"]
    # a column is looked for once, however often it is mentioned below
    ready = _settled(ready, _own=F.struct(*[last(n).alias(f"c{k}") for k, n in enumerate(_W3C_READ)]))
    get = lambda name: F.col(f"_own.c{_W3C_READ.index(name)}")

    def wrong(p: Column) -> Column:
        code = F.when((p["n"] == "c-ip") & ~is_ip(p["v"]), "invalid_ip").when((p["n"] == "sc-status") & status(p["v"]).isNull(), "invalid_status").when((p["n"] == "sc-bytes") & integer(p["v"]).isNull(), "invalid_integer")
        return F.when(code.isNotNull(), F.struct(code.alias("code"), p["n"].alias("field")))

    date, time = get("date"), get("time")
    both = date.isNotNull() & time.isNotNull()
    ready = _settled(ready, _stamp=F.concat_ws(" ", date, time))
    told = timestamp(F.col("_stamp"), {"kind": "iso8601"}, profile["timezone"])
    ready = _settled(ready, _when=F.struct(*[c.alias(n) for n, c in zip(("micros", "offset", "ok"), told, strict=True)]))
    micros, offset, ok = (F.col(f"_when.{n}") for n in ("micros", "offset", "ok"))
    first = F.try_element_at(F.filter(F.transform("_pairs", wrong), lambda e: e.isNotNull()), F.lit(1))
    stem, query = get("cs-uri-stem"), get("cs-uri-query")
    record = {column: get(name) for name, column in _W3C.items()} | {
        "client_ip": get("c-ip"), "status": status(get("sc-status")), "bytes_sent": integer(get("sc-bytes")),
        "timestamp_utc": F.when(both, F.timestamp_micros(micros)), "tz_offset_seconds": F.when(both & ok, offset),
        "request_target": F.when(query.isNotNull(), F.concat(F.coalesce(stem, F.lit("")), F.lit("?"), query)).otherwise(stem),
    }
    loose = F.filter("_pairs", lambda p: ~p["n"].isin(*_W3C_OWN) & (~p["n"].isin("date", "time") | ~both))
    kept = F.filter(F.array_distinct(F.transform(loose, lambda p: p["n"])), lambda n: n.isNotNull())
    extra = F.when(F.size(kept) > 0, F.map_from_entries(F.transform(F.array_sort(kept), lambda n: F.struct(n.alias("k"), F.try_element_at(F.filter("_pairs", lambda p: p["n"] == n), F.lit(-1))["v"].alias("v")))))
    marked = text.startswith("#")
    refused = marked & directive & ~F.size(names).between(1, W3C_FIELDS)
    error = F.when(refused, _error("invalid_directive")).when(F.col("_names").isNull(), _error("header_missing")).when(F.col("_pairs").isNull(), _error("field_count_mismatch"))
    error = error.otherwise(F.coalesce(first, F.when(both & ~ok, _error("invalid_timestamp", "date"))))
    return ready.withColumns({"_reason": F.when(is_blank(text), "blank").when(marked & ~refused, "directive"), "_error": error, "_record": _record(record, extra)})


def records(outcomes: DataFrame) -> DataFrame:
    """The records as rows of the log table, without job and batch."""
    own = outcomes.where("kind = 'record'")
    return own.select("source_id", "line_number", *[f"record.{n}" for n in RECORD_NAMES], extra_json(F.col("record.extra")).alias("extra_json"))


def match_rate(outcomes: DataFrame) -> DataFrame:
    """(source_id, records, errors, skipped, match_rate); 0 where there is neither record nor error."""
    n = {k: F.count_if(F.col("kind") == k) for k in ("record", "error", "skipped")}
    found = outcomes.groupBy("source_id").agg(n["record"].alias("records"), n["error"].alias("errors"), n["skipped"].alias("skipped"))
    whole = F.col("records") + F.col("errors")
    return found.withColumn("match_rate", F.when(whole > 0, F.col("records") / whole).otherwise(F.lit(0.0)))
