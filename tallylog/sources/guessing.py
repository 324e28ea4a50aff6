"""Formats from examples: a line is cut into pieces, and each piece's field told by its looks."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame

from tallylog.plans.schema import SAMPLE_LINES
from tallylog.sources.formats import RESERVED, validate

#: fixed values: separators in the order that they are tried, and what they need of blanks
SEPARATORS = (("|", False), ("\t", False), (",", True), (";", True))
#: fixed values: what the pieces of a line look like; each kind is given once, a number is what is left of them
LOOKS = (
    ("timestamp", "clf", r"\d{1,2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2}"),
    ("timestamp", "iso8601", r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"),
    ("client_ip", None, r"(?:\d{1,3}(?:\.\d{1,3}){3}|(?i:[0-9a-f:]+:[0-9a-f:]*))\Z"),
    ("request_line", None, r"[A-Z]{3,7} \S+(?: HTTP/\d(?:\.\d)?)?\Z"),
    ("method", None, r"(?:GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH|CONNECT|TRACE)\Z"),
    ("request_target", None, r"/"),
    ("protocol", None, r"HTTP/\d(?:\.\d)?\Z"),
    ("status", None, r"[1-5]\d\d\Z"),
    ("bytes_sent", None, r"\d+\Z"),
    ("integer", None, r"\d+\Z"),
)
_PIECE = re.compile(r'"(?P<quoted>(?:\\.|[^"\\])*)"?|\[(?P<bracketed>[^\]]*)\]?|(?P<token>[^ \t"\[][^ \t]*)')
#: fixed values: a date and the time after it
_DATE, _CLOCK = re.compile(r"\d{4}[/-]\d{2}[/-]\d{2}\Z"), re.compile(r"\d{2}:\d{2}:\d{2}(?:\.\d+)?,?\Z")


class Piece(NamedTuple):
    value: str
    capture: str


class Guess(NamedTuple):
    kind: str
    format: str | None = None


def separator(line: str) -> str | None:
    """The sign that parts the line; None for blanks."""
    return next((s for s, alone in SEPARATORS if line.count(s) >= 3 and not (alone and " " in line)), None)


def pieces(line: str, by: str | None = None) -> list[Piece]:
    """The parts of a line; between blanks a quoted or bracketed part is one, and so are a date and the time after it."""
    if by is not None:
        return [Piece(x, "pattern") for x in line.split(by)]
    found: list[Piece] = []
    for m in _PIECE.finditer(line):
        piece = Piece(m[m.lastgroup], m.lastgroup)
        if found and piece.capture == found[-1].capture == "token" and _DATE.match(found[-1].value) and _CLOCK.match(piece.value):
            found[-1] = Piece(f"{found[-1].value} {piece.value}", "pattern")
        else:
            found.append(piece)
    return found


def guesses(parts: list[Piece]) -> list[Guess]:
    """What each piece is; ``ignore`` for one that has no value."""
    given: set[str] = set()
    # a line has a method of its own or within its request
    excluded = {"request_line": {"method"}}
    found = []
    for value, capture in parts:
        own = Guess("ignore" if value in ("", "-") else "text")
        if own.kind == "text":
            if looks := next((Guess(k, f) for k, f, p in LOOKS if k not in given and not excluded.get(k, set()) & given and re.match(p, value)), None):
                own = looks
            elif capture == "quoted" and "referrer" not in given and value.startswith("http"):
                own = Guess("referrer")
            elif capture == "quoted" and "user_agent" not in given:
                own = Guess("user_agent")
        if own.kind not in ("ignore", "text", "integer"):
            given.add(own.kind)
        found.append(own)
    return found


def profile(line: str, name: str = "guessed") -> dict:
    """A format profile for lines like ``line``; what has no value there is matched but not stored."""
    by = separator(line)
    blocks: list[dict] = []
    for k, (piece, guess) in enumerate(zip(pieces(line, by), guesses(pieces(line, by)), strict=True), 1):
        if k > 1:
            blocks.append({"block": "whitespace"} if by is None else {"block": "literal", "text": by})
        capture = {"kind": piece.capture}
        if piece.capture == "pattern":
            capture["pattern"] = r"\S+ \S+" if by is None else f"[^{re.escape(by)}]*"
        if guess.kind == "ignore":
            pattern = {"quoted": r'"(?:[^"\\]|\\.)*"', "bracketed": r"\[[^\]]*\]", "token": r"\S+"}.get(piece.capture, capture.get("pattern"))
            blocks.append({"block": "regex", "pattern": pattern})
            continue
        kind = {"kind": guess.kind} | ({"format": {"kind": guess.format}} if guess.format else {})
        stored = f"field_{k}" if guess.kind in ("text", "integer") else {"request_line": "request"}.get(guess.kind, guess.kind)
        blocks.append({"block": "field", "name": stored, "kind": kind, "capture": capture, "missing": ["-"]})
    made = {"schema_version": 1, "name": name, "version": 1, "server_hint": "unknown", "timezone": {"kind": "from_input"}, "strategy": {"kind": "blocks", "blocks": blocks}}
    return made if not validate(made) and not any(RESERVED.match(b.get("name", "")) for b in blocks) else {}


# --- error logs -----------------------------------------------------------------------------

#: fixed values: what the pieces of an error line look like, by the name that they are stored under
ERROR_LOOKS = (
    ("level", r"(?i)\[?(?:emerg|alert|crit|error|warn|warning|notice|info|debug)\]?\Z"),
    ("level", r"(?i)[a-z_]+:(?:emerg|alert|crit|error|warn|notice|info|debug|trace\d?)\Z"),
    ("pid_tid", r"\d+#\d+:?\Z"),
    ("pid_tid", r"pid \d+"),
    ("connection", r"\*\d+\Z"),
    ("client", r"client \S+"),
    ("source_file", r"(?i)[a-z_]+\.c\(\d+\)\Z"),
    ("os_error", r"\(\d+\)"),
    ("error_code", r"AH\d{5}:\Z"),
)
#: fixed values: the fields that the lines of each server have, in order; the message goes on to the end
ERROR_FIELDS = {
    "nginx": ("timestamp", "level", "pid_tid", "connection", "message"),
    "apache": ("timestamp", "level", "pid_tid", "client", "log_id", "source_file", "os_error", "error_code", "message"),
    "unknown": ("timestamp", "level", "source", "message"),
}
#: fixed values: time formats of error lines, each with what such a time looks like
ERROR_TIMES = (
    ("%a %b %d %H:%M:%S%.f %Y", r"(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun) [A-Z][a-z]{2} \d{1,2} \d{2}:\d{2}:\d{2}\.\d+"),
    ("%a %b %d %H:%M:%S %Y", r"(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun) [A-Z][a-z]{2} \d{1,2} \d{2}:\d{2}:\d{2}"),
    ("%Y/%m/%d %H:%M:%S", r"\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}"),
    ("iso8601", r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"),
)


class Tail(NamedTuple):
    """An item that may follow a message as ``, key: value``."""

    key: str
    label: str
    kind: str
    name: str
    quoted: bool


#: fixed values: what follows messages, in the order in which it does
TAILS = {
    "nginx": (
        Tail("client", "클라이언트 IP", "client_ip", "client_ip", False), Tail("server", "서버", "text", "server", False), Tail("request", "요청 라인", "request_line", "request", True),
        Tail("upstream", "업스트림", "text", "upstream", True), Tail("host", "호스트", "text", "host", True), Tail("referrer", "리퍼러", "referrer", "referrer", True),
    ),
    "apache": (Tail("referer", "리퍼러", "referrer", "referrer", False),),
    "unknown": (),
}
#: an item that some lines of a server don't have, and how it looks
_MAYBE = {"connection": r"\*\d+"}


def error_roles(parts: list[Piece], server: str) -> list[str]:
    """The stored name of each piece of an error line: time, level and origin, then the message, which takes all that follows (``ignore``)."""
    fields, found = ERROR_FIELDS[server], []
    for k, (value, _) in enumerate(parts):
        if "message" in found:
            found.append("ignore")
        elif k == 0 and any(re.match(p, value) for _, p in ERROR_TIMES):
            found.append("timestamp")
        else:
            name = next((n for n, p in ERROR_LOOKS if re.match(p, value)), "message")
            if name not in fields:
                # a server without a name of its own for where a line comes from has one for all of that
                name = ("source" if "source" in fields else "text") if name in ("pid_tid", "connection", "client") else "message"
            found.append(name)
    return found


def error_profile(line: str, server: str = "unknown", name: str = "error_log", details: bool = True, offset_seconds: int = 9 * 3600) -> dict:
    """A format profile for error lines like ``line``; ``details``: with what may follow the message as fields of their own.

    Such times have no offset; ``offset_seconds`` is taken.
    """
    parts = pieces(line)
    blocks: list[dict] = []
    names: list[str] = []
    for k, (piece, role) in enumerate(zip(parts, error_roles(parts, server), strict=True)):
        if role == "ignore":
            break
        stored = role if role != "text" else f"field_{k + 1}"
        stored = stored if stored not in names else f"{stored}_{sum(n.split('_')[0] == stored for n in names) + 1}"
        names.append(stored)
        if role in _MAYBE:
            blocks.append({"block": "optional_group", "blocks": [{"block": "whitespace"}, _field(stored, "text", {"kind": "pattern", "pattern": _MAYBE[role]}, ["-"])]})
            continue
        if k:
            blocks.append({"block": "whitespace"})
        if role == "message":
            tail = TAILS[server] if details else ()
            blocks.append(_field(stored, "text", {"kind": "pattern", "pattern": ".*?" if tail else ".*"}, []))
            for t in tail:
                inner = [{"block": "literal", "text": f', {t.key}: "' if t.quoted else f", {t.key}: "}, _field(t.name, t.kind, {"kind": "pattern", "pattern": '[^"]*' if t.quoted else "[^,]+"}, ["-"])]
                blocks.append({"block": "optional_group", "blocks": [*inner, {"block": "literal", "text": '"'}] if t.quoted else inner})
            continue
        capture = {"kind": "pattern", "pattern": r"\S+ \S+"} if piece.capture == "pattern" else {"kind": piece.capture}
        block = _field(stored, "timestamp" if role == "timestamp" else "text", capture, ["-"])
        if role == "timestamp":
            form = next(f for f, p in ERROR_TIMES if re.match(p, piece.value))
            block["kind"]["format"] = {"kind": form} if form == "iso8601" else {"kind": "custom", "pattern": form}
        blocks.append(block)
    return {"schema_version": 1, "name": name, "version": 1, "server_hint": server, "timezone": {"kind": "fixed", "offset_seconds": offset_seconds}, "strategy": {"kind": "blocks", "blocks": blocks}}


def _field(name: str, kind: str, capture: dict, missing: list[str]) -> dict:
    return {"block": "field", "name": name, "kind": {"kind": kind}, "capture": capture, "missing": missing}


def roles_of(made: dict, parts: list[Piece]) -> list[str] | None:
    """The stored name of each piece of a line, by the fields of a profile in their order; None for W3C profiles.

    A field that goes on to the end of the line takes the pieces that are left; pieces beyond
    the fields have none (``ignore``).
    """
    if made["strategy"]["kind"] != "blocks":
        return None
    found: list[str] = []
    for block in made["strategy"]["blocks"]:
        if block["block"] == "regex":
            found.append("ignore")
        elif block["block"] == "field":
            found.append(block["name"])
            if block["capture"].get("pattern") in (".*", ".*?"):
                break
        elif block["block"] == "optional_group":
            inner = [b for b in block["blocks"] if b["block"] != "whitespace"]
            if len(inner) != 1 or inner[0]["block"] != "field":
                break
            found.append(inner[0]["name"])
    return [*found, *["ignore"] * len(parts)][: len(parts)]


def tail_labels(parts: list[Piece], message_at: int, tail: tuple[Tail, ...]) -> dict[int, tuple[str, str]]:
    """(label, kind) of the pieces after a message that belong to an item of its tail; only the piece with the key has the label."""
    found: dict[int, tuple[str, str]] = {}
    own: Tail | None = None
    for k in range(message_at + 1, len(parts)):
        if named := next((t for t in tail if parts[k].value == f"{t.key}:"), None):
            own = named
        if own:
            found[k] = (own.label if named else "", own.kind)
    return found


def profiles(heads: DataFrame) -> dict[int, dict]:
    """A profile for each source of ``heads`` (its first lines), from the line whose profile matches most of the first SAMPLE_LINES."""
    from tallylog.sources.formats import compile_blocks

    few = heads.where(f"line_number <= {SAMPLE_LINES}").orderBy("source_id", "line_number").collect()
    found: dict[int, dict] = {}
    for source in dict.fromkeys(r["source_id"] for r in few):
        texts = [r["value"].rstrip("\r") for r in few if r["source_id"] == source and r["value"] and r["value"].strip()]
        best = 0
        for made in filter(None, map(profile, texts)):
            pattern = re.compile(compile_blocks(made).pattern.replace(r"\z", r"\Z"), re.DOTALL)
            hits = sum(bool(pattern.match(t)) for t in texts)
            if hits > best:
                best, found[source] = hits, made
    return found
