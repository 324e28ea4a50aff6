"""Log text rendered from parsed rows; values that aren't there are not guessed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallylog.sources.formats import groups_in


def _dash(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("-"))


def _zone(offset: Column) -> Column:
    size = F.abs(offset)
    return F.concat(F.when(offset < 0, "-").otherwise("+"), F.lpad((size / 3600).cast("int").cast("string"), 2, "0"), F.lpad((size % 3600 / 60).cast("int").cast("string"), 2, "0"))


def time_text(form: dict) -> Column:
    """The row's time at the offset that it was written with."""
    offset = F.coalesce("tz_offset_seconds", F.lit(0))
    local = F.timestamp_micros(F.unix_micros("timestamp_utc") + offset.cast("bigint") * 1_000_000)
    zone = _zone(offset)
    if form.get("kind") == "clf":
        return F.concat(F.date_format(local, "dd/MMM/yyyy:HH:mm:ss "), zone)
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, 4, 2)))


def _request(whole: bool) -> Column:
    none = F.col("method").isNull() & F.col("request_target").isNull() & F.col("protocol").isNull()
    parts = F.concat_ws(" ", _dash("method"), _dash("request_target"), _dash("protocol"))
    if whole:
        return F.when(none, "-").otherwise(parts)
    alone = F.col("method").isNull() & F.col("protocol").isNull()
    return F.when(~none, F.when(alone, F.col("request_target")).otherwise(parts))


def combined_like() -> Column:
    """The standard text."""
    return F.concat(
        _dash("client_ip"), F.lit(" - - ["), F.coalesce(time_text({"kind": "clf"}), F.lit("-")), F.lit('] "'), _request(True), F.lit('" '), _dash("status"), F.lit(" "),
        _dash("bytes_sent"), F.lit(' "'), _dash("referrer"), F.lit('" "'), _dash("user_agent"), F.lit('"'),
    )


def _value(kind: dict, name: str) -> Column:
    match kind["kind"]:
        case "timestamp":
            return F.when(F.col("timestamp_utc").isNotNull(), time_text(kind.get("format", {})))
        case "request_line":
            return _request(False)
        case "integer" | "text":
            return F.try_element_at(F.from_json("extra_json", "map<string,string>"), F.lit(name))
        case other:
            return F.col(other).cast("string")


def _blocks(blocks: list[dict]) -> tuple[Column, Column, bool]:
    """(text, whether a field has a value, whether the text is all there was)."""
    parts, held, complete = [F.lit("")], F.lit(False), True
    for b in blocks:
        match b["block"]:
            case "literal":
                parts.append(F.lit(b["text"]))
            case "whitespace":
                parts.append(F.lit(" "))
            case "field":
                value = _value(b["kind"], b["name"])
                held = held | value.isNotNull()
                text = F.coalesce(value, F.lit((b.get("missing") or ["-"])[0]))
                left, right = {"quoted": ('"', '"'), "bracketed": ("[", "]")}.get(b["capture"]["kind"], ("", ""))
                parts.append(F.concat(F.lit(left), text, F.lit(right)))
            case "regex":
                complete = False
                for name in filter(None, groups_in(b["pattern"])):
                    held = held | F.try_element_at(F.from_json("extra_json", "map<string,string>"), F.lit(name)).isNotNull()
                parts.append(F.lit("…"))
            case "optional_group":
                text, there, own = _blocks(b["blocks"])
                held, complete = held | there, complete and own
                parts.append(F.when(there, text).otherwise(""))
    return F.concat(*parts), held, complete


def by_profile(profile: dict) -> tuple[Column, bool]:
    """(text, whether it can be complete) in the order of the profile's blocks."""
    if profile["strategy"]["kind"] != "blocks":
        return combined_like(), False
    text, _, complete = _blocks(profile["strategy"]["blocks"])
    return text, complete
