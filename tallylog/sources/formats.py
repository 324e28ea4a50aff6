"""Format profiles: declarative descriptions of single-line log formats, and their regular expressions.

A profile is plain data (what its JSON and YAML files hold).  Its blocks compile to one
regular expression with numbered groups: one a field, one around each optional group, which
tells an absent field from an empty one, and one a named capture of a regex block.
"""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field
from pathlib import Path

from tallylog.functions.regex_dialect import PatternError, to_java
from tallylog.plans.schema import BLOCKS, NAME_CHARS, NESTING, PATTERN_BYTES, YAML_BYTES

#: fixed values: kinds of fields, and the record's columns they fill
KINDS = {
    "client_ip": "client_ip", "timestamp": "timestamp_utc", "request_line": None, "method": "method", "request_target": "request_target", "protocol": "protocol",
    "status": "status", "bytes_sent": "bytes_sent", "referrer": "referrer", "user_agent": "user_agent", "integer": None, "text": None,
}
#: fixed values: what a field's text may be
CAPTURES = {"token": r"([^ \t]+)", "quoted": r'"((?:[^"\\]|\\.)*)"', "bracketed": r"\[([^\]]*)\]"}
HINTS = ("apache", "nginx", "iis", "unknown")
RESERVED = re.compile(r"f[0-9]+\Z")


class ProfileError(ValueError):
    pass


def _field(name: str, kind: str, capture: str = "token", **more: object) -> dict:
    return {"block": "field", "name": name, "kind": {"kind": kind, **more}, "capture": {"kind": capture}, "missing": ["-"]}


def _spaced(*fields: dict) -> list[dict]:
    found = [fields[0]]
    for f in fields[1:]:
        found += [{"block": "whitespace"}, f]
    return found


_COMMON = (
    _field("client_ip", "client_ip"), _field("ident", "text"), _field("remote_user", "text"), _field("timestamp", "timestamp", "bracketed", format={"kind": "clf"}),
    _field("request", "request_line", "quoted"), _field("status", "status"), _field("bytes_sent", "bytes_sent"),
)
_AGENTS = (_field("referrer", "referrer", "quoted"), _field("user_agent", "user_agent", "quoted"))


def _profile(name: str, hint: str, timezone: dict, strategy: dict) -> dict:
    return {"schema_version": 1, "name": name, "version": 1, "server_hint": hint, "timezone": timezone, "strategy": strategy}


def preset(name: str) -> dict | None:
    """A built-in profile, or None."""
    input_zone = {"kind": "from_input"}
    if name in ("combined", "apache_combined", "nginx_combined"):
        return _profile("combined", {"a": "apache", "n": "nginx"}.get(name[0], "unknown"), input_zone, {"kind": "blocks", "blocks": _spaced(*_COMMON, *_AGENTS)})
    if name == "common":
        return _profile("common", "unknown", input_zone, {"kind": "blocks", "blocks": _spaced(*_COMMON)})
    if name in ("iis_w3c", "w3c"):
        return _profile("iis_w3c", "iis", {"kind": "utc"}, {"kind": "w3c"})
    return None


PRESETS = ("common", "combined", "apache_combined", "nginx_combined", "iis_w3c")


@dataclass
class FieldDef:
    name: str
    kind: str
    group: int
    missing: list[str]
    #: groups around it that are empty where it is absent
    within: list[int]
    format: dict | None = None


@dataclass
class Compiled:
    pattern: str
    groups: int
    fields: list[FieldDef] = field(default_factory=list)
    #: (name, group, optional groups around it) of named captures
    extras: list[tuple[str, int, list[int]]] = field(default_factory=list)


def groups_in(pattern: str) -> list[str | None]:
    """The capturing groups of a pattern, by name or None."""
    found, k, inside = [], 0, False
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 1
        elif c == "[" and not inside:
            inside = True
            if pattern[k + 1 : k + 2] == "]" or pattern[k + 1 : k + 3] == "^]":
                k += 1 + (pattern[k + 1] == "^")
        elif c == "]":
            inside = False
        elif c == "(" and not inside:
            if pattern[k + 1 : k + 2] != "?":
                found.append(None)
            elif m := re.match(r"\(\?P?<([A-Za-z_][A-Za-z0-9_]*)>", pattern[k:]):
                found.append(m[1])
        k += 1
    return found


class _Compiler:
    def __init__(self) -> None:
        self.out, self.count = [], 0
        self.fields: list[FieldDef] = []
        self.extras: list[tuple[str, int, list[int]]] = []

    def blocks(self, blocks: list[dict], within: list[int], depth: int = 1) -> None:
        if depth > NESTING:
            raise ProfileError(f"groups are nested over {NESTING} levels")
        for b in blocks:
            match b["block"]:
                case "literal":
                    self.out.append(re.sub(r"([^A-Za-z0-9 _])", r"\\\1", b["text"]))
                case "whitespace":
                    self.out.append(r"[ \t]+")
                case "field":
                    self.field(b, within)
                case "regex":
                    self.regex(b["pattern"], within)
                case "optional_group":
                    self.count += 1
                    self.out.append("(")
                    self.blocks(b["blocks"], [*within, self.count], depth + 1)
                    self.out.append(")?")
                case other:
                    raise ProfileError(f"an unknown block: {other}")

    def field(self, b: dict, within: list[int]) -> None:
        capture = b["capture"]
        if capture["kind"] == "pattern":
            body = f"((?:{to_java(capture['pattern'])}))"
            more = len(groups_in(capture["pattern"]))
        else:
            body, more = CAPTURES[capture["kind"]], 0
        self.fields.append(FieldDef(b["name"], b["kind"]["kind"], self.count + 1, b.get("missing", []), within, b["kind"].get("format")))
        self.count += 1 + more
        self.out.append(body)

    def regex(self, pattern: str, within: list[int]) -> None:
        names = groups_in(pattern)
        for k, name in enumerate(names, 1):
            if name is not None:
                if RESERVED.match(name):
                    raise ProfileError("the name of a group is reserved")
                self.extras.append((name, self.count + k, within))
        self.count += len(names)
        self.out.append(f"(?:{to_java(pattern)})")


def compile_blocks(profile: dict) -> Compiled:
    made = _Compiler()
    made.blocks(profile["strategy"]["blocks"], [])
    names = [f.name for f in made.fields] + [n for n, _, _ in made.extras]
    if not made.fields:
        raise ProfileError("the profile has no field")
    if len(set(names)) < len(names):
        raise ProfileError("a name is used more than once")
    if any(RESERVED.match(n) for n in names):
        raise ProfileError("a name is reserved")
    pattern = "\\A" + "".join(made.out) + "\\z"
    if len(pattern.encode()) > PATTERN_BYTES:
        raise ProfileError(f"the pattern is over {PATTERN_BYTES} bytes")
    return Compiled(pattern, made.count, made.fields, made.extras)


def validate(profile: dict) -> list[tuple[str, str]]:
    """(path, issue) of all that is wrong with a profile."""
    found: list[tuple[str, str]] = []
    if profile.get("schema_version") != 1:
        found.append(("schema_version", "unknown version"))
    if not 1 <= len(str(profile.get("name", "")).strip()) <= NAME_CHARS:
        found.append(("name", f"1 to {NAME_CHARS} characters"))
    if profile.get("server_hint", "unknown") not in HINTS:
        found.append(("server_hint", "unknown value"))
    zone = profile.get("timezone", {})
    if zone.get("kind") not in ("from_input", "fixed", "utc"):
        found.append(("timezone", "unknown policy"))
    elif zone["kind"] == "fixed" and not abs(zone.get("offset_seconds", 10**9)) <= 64_800:
        found.append(("timezone.offset_seconds", "out of range"))
    strategy = profile.get("strategy", {})
    if strategy.get("kind") == "w3c":
        return found
    if strategy.get("kind") != "blocks":
        return [*found, ("strategy", "unknown strategy")]

    def look(blocks: list[dict], path: str) -> int:
        n = 0
        for k, b in enumerate(blocks):
            at = f"{path}[{k}]"
            n += 1
            kind = b.get("block")
            if kind == "field":
                if not 1 <= len(b.get("name", "")) <= NAME_CHARS:
                    found.append((f"{at}.name", f"1 to {NAME_CHARS} characters"))
                if b.get("kind", {}).get("kind") not in KINDS:
                    found.append((f"{at}.kind", "unknown kind"))
                if b.get("capture", {}).get("kind") not in (*CAPTURES, "pattern"):
                    found.append((f"{at}.capture", "unknown capture"))
            elif kind == "literal" and not b.get("text"):
                found.append((f"{at}.text", "empty"))
            elif kind == "optional_group":
                if not b.get("blocks"):
                    found.append((f"{at}.blocks", "empty"))
                n += look(b.get("blocks", []), f"{at}.blocks")
            elif kind not in ("literal", "whitespace", "regex"):
                found.append((at, "unknown block"))
        return n

    if look(strategy.get("blocks", []), "strategy.blocks") > BLOCKS:
        found.append(("strategy.blocks", f"over {BLOCKS} blocks"))
    if not found:
        try:
            compile_blocks(profile)
        except (ProfileError, PatternError, KeyError) as error:
            found.append(("strategy.blocks", str(error)))
    return found


def definition_hash(profile: dict) -> str:
    """FNV-1a, 64 bits, over the definition with sorted keys: equal definitions, equal hashes."""
    value = 0xCBF29CE484222325
    for b in json.dumps(profile, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode():
        value = (value ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return f"{value:016x}"


def from_text(text: str) -> dict:
    """A profile from JSON, or from YAML where a YAML library is at hand."""
    if len(text.encode()) > YAML_BYTES:
        raise ProfileError(f"a profile has at most {YAML_BYTES} bytes")
    try:
        return json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError:
            raise ProfileError("no YAML library is installed; JSON is read without one") from None
        return yaml.safe_load(text)


class Library:
    """Profiles kept as files ``<name>.json`` of one folder; a file is replaced in one step."""

    def __init__(self, folder: str):
        self.folder = Path(folder)

    def _path(self, name: str) -> Path:
        if not re.fullmatch(r"[\w.-]{1,64}", name) or name.startswith("."):
            raise ProfileError("not a name for a file")
        if preset(name):
            raise ProfileError("the name of a built-in profile")
        return self.folder / f"{name}.json"

    def save(self, name: str, profile: dict) -> None:
        if issues := validate(profile):
            raise ProfileError("; ".join(f"{p}: {i}" for p, i in issues))
        path = self._path(name)
        self.folder.mkdir(parents=True, exist_ok=True)
        part = path.with_suffix(".part")
        part.write_text(json.dumps(profile, indent=2, ensure_ascii=False))
        os.replace(part, path)

    def load(self, name: str) -> dict:
        return preset(name) or from_text(self._path(name).read_text())

    def names(self) -> list[str]:
        return sorted(p.stem for p in self.folder.glob("*.json"))

    def delete(self, name: str) -> None:
        self._path(name).unlink()
