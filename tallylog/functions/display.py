"""Text for display: classes, summaries, sizes, offsets, decoding.  All are Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: what stands for a value that isn't there
NO_VALUE, NO_TIME, NO_OFFSET, NO_CONTENT = "–", "(시간 미확정)", "미확정", "(내용 없음)"
#: fixed values: how methods are told apart
READING, WRITING, DELETING = ("GET", "HEAD", "OPTIONS", "TRACE"), ("POST", "PUT", "PATCH", "CONNECT"), ("DELETE",)
#: fixed values: words of a level that make it an error
SEVERE = ("emerg", "alert", "crit", "error")
#: seconds by which times are shown later than UTC
SHOWN_OFFSET = 9 * 3600
#: a mark of byte order, which decoding drops where it is first
_MARK = "\ufeff"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, not at each place where it stands."""
    return F.element_at(F.transform(F.array(value), use), 1)


def status_class(status: Column) -> Column:
    """s2 to s5 by the hundreds, from 500 on s5; s0 below 200 and without a status."""
    return F.when(status >= 500, "s5").when(status >= 400, "s4").when(status >= 300, "s3").when(status >= 200, "s2").otherwise("s0")


def method_class(method: Column) -> Column:
    name = F.upper(F.coalesce(method, F.lit("")))
    return F.when(name == "", "m-none").when(name.isin(*READING), "m-read").when(name.isin(*WRITING), "m-write").when(name.isin(*DELETING), "m-del").otherwise("m-odd")


def level_class(level: Column) -> Column:
    """By the words that it holds; a module name before a colon doesn't matter."""
    low = F.lower(level)
    severe = F.contains(low, F.lit(SEVERE[0]))
    for word in SEVERE[1:]:
        severe = severe | F.contains(low, F.lit(word))
    return F.when(severe, "s5").when(F.contains(low, F.lit("warn")), "s4").otherwise("s0")


def _entry(extra: Column, name: str) -> Column:
    return F.coalesce(F.get_json_object(extra, f"$.{name}"), F.lit(""))


def error_level(extra: Column) -> Column:
    return _entry(extra, "level")


def error_client(ip: Column, extra: Column) -> Column:
    return F.coalesce(ip, _entry(extra, "client"))


def error_text(extra: Column) -> Column:
    """The message, after its code where there is one; without a message, the other fields as ``k=v``."""
    fields = F.map_entries(F.from_json(extra, "map<string,string>"))
    others = F.filter(fields, lambda e: ~e["key"].isin("level", "client") & (F.coalesce(e["value"], F.lit("")) != ""))
    joined = F.coalesce(F.array_join(F.transform(others, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", "), F.lit(""))
    message, code = _entry(extra, "message"), _entry(extra, "error_code")
    return F.when(message == "", joined).when(code != "", F.concat(code, F.lit(" "), message)).otherwise(message)


def row_summary() -> Column:
    """One line of text for a row of either kind; a row with a message is an error's."""
    message, level = error_text(F.col("extra_json")), error_level(F.col("extra_json"))
    client = error_client(F.col("client_ip"), F.col("extra_json"))
    some = lambda c: F.when(c != "", c)
    request = F.concat_ws(" ", some(F.col("method")), some(F.col("request_target")))
    access = F.concat_ws(" · ", some(request), F.col("status").cast("string"), some(client))
    error = F.concat_ws(" · ", some(level), message, some(client))
    return F.coalesce(some(F.when(message == "", access).otherwise(error)), F.lit(NO_CONTENT))


def bytes_text(n: Column) -> Column:
    """1,024-based; one digit after the point below 100 of a unit, none from there on."""
    text = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        value = n / float(1024**k)
        text = F.when(n >= 1024**k, F.concat(F.when(value >= 100, F.format_string("%.0f", value)).otherwise(F.format_string("%.1f", value)), F.lit(f" {unit}"))).otherwise(text)
    return F.coalesce(text, F.lit(NO_VALUE))


def offset_text(seconds: Column) -> Column:
    size = F.abs(seconds)
    two = lambda n: F.lpad(F.floor(n).cast("string"), 2, "0")
    return F.coalesce(F.concat(F.when(seconds < 0, "UTC-").otherwise("UTC+"), two(size / 3600), F.lit(":"), two((size % 3600) / 60)), F.lit(NO_OFFSET))


def time_text(time: Column) -> Column:
    """The time where it is shown, to the second."""
    return F.coalesce(F.date_format(time + F.expr(f"INTERVAL {SHOWN_OFFSET} SECONDS"), "yyyy-MM-dd HH:mm:ss"), F.lit(NO_TIME))


def iso_utc(time: Column) -> Column:
    return F.coalesce(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit(""))


def url_decoded(text: Column) -> Column:
    """Runs of percent codes decoded where they are UTF-8, all else as it is; ``+`` stays."""
    parts = F.regexp_extract_all(text, F.lit("((?:%[0-9a-fA-F]{2})+|[^%]+|%)"), F.lit(1))

    def one(part: Column) -> Column:
        return let(F.unhex(F.replace(part, F.lit("%"), F.lit(""))).cast("string"), lambda made: F.when((F.length(part) > 1) & part.startswith("%") & F.is_valid_utf8(made), made).otherwise(part))

    return F.when(text.contains("%"), F.array_join(F.transform(parts, one), "")).otherwise(text)


def escaped_bytes(text: Column) -> Column:
    r"""The bytes of a text with ``\xHH`` escapes, as hexadecimal digits."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)(\\x[0-9a-fA-F]{2}|(?:(?!\\x[0-9a-fA-F]{2}).)+)"), F.lit(1))
    return F.upper(F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"\A\\x[0-9a-fA-F]{2}\z"), F.substring(p, 3, 2)).otherwise(F.hex(p.cast("binary")))), ""))


def printable(digits: Column) -> Column:
    """Bytes, as hexadecimal digits, as UTF-8; a dot for each control character and each part that isn't UTF-8."""
    text = F.make_valid_utf8(F.unhex(digits).cast("string"))
    return F.regexp_replace(F.regexp_replace(text, f"\\A{_MARK}", ""), r"[\x{FFFD}\x00-\x1F\x7F-\x9F]", "·")


def hex_decoded(text: Column) -> Column:
    r"""``\xHH`` escapes as the text whose bytes they are."""
    return F.when(text.rlike(r"\\x[0-9a-fA-F]{2}"), printable(escaped_bytes(text))).otherwise(text)


def _byte(digits: Column, k: int | Column) -> Column:
    """Byte ``k``; null beyond the end."""
    at = F.lit(k) if isinstance(k, int) else k
    part = F.substring(digits, at * 2 + 1, F.lit(2))
    return F.when(F.length(part) == 2, F.conv(part, 16, 10).cast("int"))


def _two(digits: Column, at: Column) -> Column:
    return _byte(digits, at) * 256 + _byte(digits, at + 1)


def protocol_guess(text: Column) -> Column:
    r"""What a garbage request line of ``\xHH`` escapes begins like; null if like nothing known."""
    return F.when(text.rlike(r"\\x[0-9a-fA-F]{2}"), let(escaped_bytes(text), _protocol))


def _protocol(digits: Column) -> Column:
    b = [_byte(digits, k) for k in range(11)]
    version = F.when((b[9] == 3) & (b[10] >= 3), "TLS 1.2+").when((b[9] == 3) & (b[10] == 2), "TLS 1.1").when((b[9] == 3) & (b[10] == 1), "TLS 1.0").otherwise("TLS")
    # fixed values: what the descriptions say
    return (
        F.when((b[0] == 0x16) & (b[1] == 3) & (b[2] <= 4) & (b[5] == 1), F.concat(version, F.lit(" ClientHello — HTTPS 핸드셰이크를 HTTP 포트로 보냄")))
        .when((b[0] == 0x80) & (b[2] == 1), "SSLv2 ClientHello(구식 스캐너)")
        .when((b[0] == 5) & b[1].between(1, 3), "SOCKS5 핸드셰이크")
        .when((b[0] == 4) & (b[1] == 1), "SOCKS4 CONNECT")
        .when((b[0] == 0) & (b[1] == 0) & (b[2] == 0) & (b[3] >= 8), "길이 접두 이진 프로토콜(예: RDP/Java 직렬화)")
    )


def server_name(text: Column) -> Column:
    r"""The host that a TLS greeting in ``\xHH`` escapes asks for; null where it has none or is cut short."""
    return F.when(text.rlike(r"\\x[0-9a-fA-F]{2}"), let(escaped_bytes(text), _server_name))


def _server_name(digits: Column) -> Column:
    hello = (_byte(digits, 0) == 0x16) & (_byte(digits, 1) == 3) & (_byte(digits, 2) <= 4) & (_byte(digits, 5) == 1)
    # after the heads, the version and the random bytes: session, ciphers and compressions, each with its length
    session = F.lit(43)
    chain = lambda at, size, use: let(at + size, use)

    def extensions(at: Column) -> Column:
        stop = F.least(F.length(digits) / 2, at + 2 + _two(digits, at)).cast("int")
        start = F.struct((at + 2).alias("at"), F.lit(None).cast("int").alias("name"))

        def step(now: Column, _: Column) -> Column:
            here = now["at"]
            found = F.when(now["name"].isNull() & (_two(digits, here) == 0), here + 4).otherwise(now["name"])
            return F.struct(F.when(found.isNull() & (here + 4 <= stop), here + 4 + _two(digits, here + 2)).otherwise(here).alias("at"), F.when(here + 4 <= stop, found).otherwise(now["name"]).alias("name"))

        # an extension has four bytes at least
        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.coalesce((stop - at) / 4, F.lit(0)).cast("int"))), start, step)["name"]

    def named(at: Column) -> Column:
        size = _two(digits, at + 3)
        whole = (_byte(digits, at + 2) == 0) & ((at + 5 + size) * 2 <= F.length(digits))
        return F.when(whole, printable(F.substring(digits, (at + 5) * 2 + 1, size * 2)))

    found = chain(session, _byte(digits, session) + 1, lambda a: chain(a, _two(digits, a) + 2, lambda b: chain(b, _byte(digits, b) + 1, extensions)))
    return F.when(hello, let(found, lambda at: F.when(at.isNotNull(), named(at))))


def natural_key(name: Column) -> Column:
    """Sorts names with their numbers by size and their letters whatever the case."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    number = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.struct(F.lit(0).alias("kind"), F.length(number(p)).alias("size"), number(p).alias("text"))).otherwise(F.struct(F.lit(1).alias("kind"), F.lit(0).alias("size"), p.alias("text"))))


def base_name(path: Column) -> Column:
    return F.coalesce(F.try_element_at(F.filter(F.split(path, r"[\\/]+"), lambda p: p != ""), F.lit(-1)), F.lit(""))
