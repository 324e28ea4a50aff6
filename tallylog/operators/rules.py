"""The rule language: rule text to a condition tree."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from tallylog.functions.regex_dialect import PatternError, to_java
from tallylog.operators.filters import NUMERIC, Always, And, Cond, Expr, LogFilter, Not, Or, size_of

#: fixed values: names of fields in rules
ALIASES = {
    "status": "status", "bytes": "bytes_sent", "bytes_sent": "bytes_sent", "method": "method", "ip": "client_ip", "client_ip": "client_ip",
    "path": "request_target", "url": "request_target", "target": "request_target", "request_target": "request_target", "protocol": "protocol",
    "referrer": "referrer", "referer": "referrer", "ua": "user_agent", "user_agent": "user_agent", "level": "level", "message": "message", "msg": "message",
}
COMPARE = {"==": "eq", "!=": "ne", ">": "gt", ">=": "gte", "<": "lt", "<=": "lte"}
TEXT_OPS = {"contains": "contains", "icontains": "icontains", "startswith": "starts_with", "endswith": "ends_with", "matches": "regex"}
#: words that the rule text of a regular expression may follow
BEFORE_REGEX = ("=", "(", ",", "matches", "contains", "icontains")

_TOKEN = re.compile(
    r"""(?P<gap>[ \t\r\n]+|//[^\n]*|/\*.*?\*/)|(?P<str>"(?:[^"\\\n]|\\.)*")|(?P<var>\$[A-Za-z0-9_]*\*?)|(?P<num>[0-9]+)|(?P<word>[A-Za-z_][A-Za-z0-9_]*)"""
    r"""|(?P<op>\.\.|==|!=|>=|<=|[{}():=,<>])""",
    re.DOTALL,
)
_REGEX = re.compile(r"/((?:[^/\\\n]|\\.)*)/([A-Za-z]*)")


class RuleError(ValueError):
    def __init__(self, text: str, at: int, message: str):
        self.line = text.count("\n", 0, at) + 1
        self.col = at - (text.rfind("\n", 0, at) + 1) + 1
        super().__init__(f"{self.line}:{self.col}: {message}")


@dataclass(frozen=True)
class Token:
    kind: str
    value: str
    at: int
    flags: str = ""


@dataclass
class Rule:
    name: str
    expr: Expr
    meta: dict[str, object] = field(default_factory=dict)


def tokens(text: str) -> list[Token]:
    found, at = [], 0
    while at < len(text):
        if text[at] == "/" and text[at : at + 2] not in ("//", "/*") and found and found[-1].kind in ("op", "word") and found[-1].value.lower() in BEFORE_REGEX:
            m = _REGEX.match(text, at)
            if not m:
                raise RuleError(text, at, "the regular expression doesn't end")
            found.append(Token("re", m[1], at, m[2]))
            at = m.end()
            continue
        m = _TOKEN.match(text, at)
        if not m:
            raise RuleError(text, at, "the text doesn't end" if text[at] == '"' else "the comment doesn't end" if text[at : at + 2] == "/*" else "an unknown character")
        value = m[0]
        if m.lastgroup == "str":
            value = re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t"}.get(e[1], e[1]), value[1:-1], flags=re.DOTALL)
        elif m.lastgroup == "var":
            value = value[1:]
            if not value:
                raise RuleError(text, at, "a name has to follow $")
        if m.lastgroup != "gap":
            found.append(Token(m.lastgroup, value, at))
        at = m.end()
    return [*found, Token("end", "", len(text))]


@dataclass(frozen=True)
class Pattern:
    kind: str
    value: str
    nocase: bool


class _Reader:
    """Recursive descent over the tokens of one rule."""

    def __init__(self, text: str, default: str):
        self.text, self.default, self.all, self.k = text, default, tokens(text), 0
        self.strings: dict[str, Pattern] = {}

    @property
    def now(self) -> Token:
        return self.all[self.k]

    def fail(self, message: str) -> RuleError:
        return RuleError(self.text, self.now.at, message)

    def take(self, *values: str, kind: str = "") -> Token | None:
        t = self.now
        if (kind and t.kind == kind) or (not kind and t.kind in ("op", "word") and t.value.lower() in values):
            self.k += 1
            return t
        return None

    def need(self, *values: str, kind: str = "") -> Token:
        t = self.take(*values, kind=kind)
        if t is None:
            raise self.fail(f"{kind or ' or '.join(values)} is missing here")
        return t

    def rule(self) -> Rule:
        self.need("rule")
        name = self.need(kind="word").value
        self.need("{")
        meta, start = {}, None
        while not self.take("}"):
            section = self.need("meta", "strings", "condition").value
            self.need(":")
            if section == "meta":
                while self.now.kind == "word" and self.all[self.k + 1].value == "=":
                    key = self.need(kind="word").value
                    self.need("=")
                    value = self.take(kind="str") or self.take(kind="num") or self.need("true", "false")
                    meta[key] = int(value.value) if value.kind == "num" else value.value
            elif section == "strings":
                while self.now.kind == "var":
                    self.string()
            else:
                start = self.k
                while self.now.kind != "end" and not (self.now.value == "}" or self.now.kind == "word" and self.now.value in ("meta", "strings") and self.all[self.k + 1].value == ":"):
                    self.k += 1
        if self.now.kind != "end":
            raise self.fail("one rule is all a text holds")
        if start is None:
            raise self.fail("condition is missing")
        self.k = start
        expr = self.disjunction()
        if not (self.now.value == "}" or self.now.value in ("meta", "strings")):
            raise self.fail("the condition goes on where it should end")
        return Rule(name, expr, meta)

    def string(self) -> None:
        name = self.need(kind="var")
        if name.value in self.strings:
            raise self.fail("the name is taken")
        self.need("=")
        value = self.take(kind="str") or self.need(kind="re")
        nocase = "i" in value.flags
        while word := self.take("nocase", "ascii", "wide"):
            nocase |= word.value.lower() == "nocase"
        if value.kind == "re":
            self.check(value.value)
        self.strings[name.value] = Pattern(value.kind, value.value, nocase)

    def check(self, pattern: str) -> None:
        try:
            to_java(pattern)
        except PatternError as error:
            raise self.fail(str(error)) from None

    def disjunction(self) -> Expr:
        parts = [self.conjunction()]
        while self.take("or"):
            parts.append(self.conjunction())
        return parts[0] if len(parts) == 1 else Or(tuple(parts))

    def conjunction(self) -> Expr:
        parts = [self.negation()]
        while self.take("and"):
            parts.append(self.negation())
        return parts[0] if len(parts) == 1 else And(tuple(parts))

    def negation(self) -> Expr:
        return Not(self.negation()) if self.take("not") else self.primary()

    def primary(self) -> Expr:
        if self.take("("):
            expr = self.disjunction()
            self.need(")")
            return expr
        if self.take("true"):
            return Always()
        if self.take("false"):
            return Not(Always())
        if word := self.take("any", "all"):
            self.need("of")
            parts = tuple(self.applied(self.strings[n], self.default) for n in self.chosen())
            return (Or if word.value.lower() == "any" else And)(parts)
        if self.now.kind == "var":
            return self.applied(self.string_at(self.need(kind="var")), self.default)
        name = self.need(kind="word")
        if name.value.lower() not in ALIASES:
            raise RuleError(self.text, name.at, "an unknown field")
        return self.test(ALIASES[name.value.lower()])

    def chosen(self) -> list[str]:
        """Names that ``them`` or a list stands for; ``$a*`` stands for all that begin so."""
        if self.take("them"):
            found = list(self.strings)
        else:
            self.need("(")
            found = []
            while True:
                t = self.need(kind="var")
                if t.value.endswith("*"):
                    found += [n for n in self.strings if n.startswith(t.value[:-1])]
                else:
                    self.string_at(t)
                    found.append(t.value)
                if not self.take(","):
                    break
            self.need(")")
        if not found:
            raise self.fail("the set of strings is empty")
        return found

    def string_at(self, t: Token) -> Pattern:
        if t.value not in self.strings:
            raise RuleError(self.text, t.at, "an undefined string")
        return self.strings[t.value]

    def applied(self, p: Pattern, name: str) -> Expr:
        """A string stands for a search in the field, whatever word comes before it."""
        if p.kind == "re":
            return Cond(name, "regex", ("(?i)" if p.nocase else "") + p.value)
        return Cond(name, "icontains" if p.nocase else "contains", p.value)

    def text_of(self, t: Token) -> str:
        p = self.string_at(t)
        if p.kind != "str":
            raise RuleError(self.text, t.at, "only a text can stand here")
        return p.value

    def literal(self, name: str) -> str:
        t = self.take(kind="num") or self.take(kind="str")
        if t is None or (name in NUMERIC) != (t.kind == "num"):
            raise self.fail("a number has to follow" if name in NUMERIC else "a text has to follow")
        return t.value

    def test(self, name: str) -> Expr:
        if t := self.take(*COMPARE):
            if name not in NUMERIC and t.value not in ("==", "!="):
                raise self.fail("a text field can't be ordered")
            if name not in NUMERIC and self.now.kind == "var":
                return Cond(name, COMPARE[t.value], self.text_of(self.need(kind="var")))
            return Cond(name, COMPARE[t.value], self.literal(name))
        if self.take("in"):
            if self.take("("):
                values = [self.literal(name)]
                while self.take(","):
                    values.append(self.literal(name))
                self.need(")")
                return Or(tuple(Cond(name, "eq", v) for v in values))
            if name not in NUMERIC:
                raise self.fail("only numbers have ranges")
            low = self.literal(name)
            self.need("..")
            return And((Cond(name, "gte", low), Cond(name, "lte", self.literal(name))))
        if self.take("is"):
            negated = self.take("not") is not None
            self.need("null", "empty")
            return Not(Cond(name, "is_null")) if negated else Cond(name, "is_null")
        word = self.need(*TEXT_OPS)
        if name in NUMERIC:
            raise self.fail("a numeric field can only be compared")
        op = TEXT_OPS[word.value.lower()]
        if t := self.take(kind="var"):
            return Cond(name, op, self.text_of(t)) if op in ("starts_with", "ends_with") else self.applied(self.string_at(t), name)
        if op in ("regex", "contains") and (t := self.take(kind="re")):
            self.check(t.value)
            return self.applied(Pattern("re", t.value, "i" in t.flags), name)
        t = self.need(kind="str")
        if op == "regex":
            self.check(t.value)
        return Cond(name, op, t.value)


def parse_rule(text: str, kind: str = "access") -> Rule:
    """The one rule in ``text``; bare strings apply to the target of access logs and the message of error logs."""
    rule = _Reader(text, "message" if kind == "error" else "request_target").rule()
    size_of(rule.expr)
    return rule



def describe(expr: Expr) -> str:
    """The tree on one line."""
    match expr:
        case Always() | And(()) | Or(()):
            return "true"
        case And(items):
            return " and ".join(f"({describe(x)})" if isinstance(x, Or) else describe(x) for x in items)
        case Or(items):
            return " or ".join(describe(x) for x in items)
        case Not(item):
            return f"not ({describe(item)})"
    return f"{expr.field} is null" if expr.op == "is_null" else f"{expr.field} {expr.op} {expr.value}"


def describe_filter(f: LogFilter) -> str:
    """A filter on one line, as it is shown for views that have no rule of their own."""
    # fixed values: the words of the line
    parts = [f"상태 {f.status}"] if f.status is not None else [f"상태 {f.status_class}xx"] if f.status_class is not None else []
    parts += [f"메서드 {f.method}"] if f.method else []
    parts += [f"IP {f.client_ip}"] if f.client_ip else []
    parts += [f'경로에 "{f.target_contains}" 포함'] if f.target_contains else []
    parts += ["경로 정규식"] if f.target_regex else []
    parts += [describe(f.expr)] if f.expr is not None else []
    parts += ["시간 범위"] if f.time_from is not None or f.time_to is not None else []
    parts += [f"작업 {f.job_id}"] if f.job_id is not None else []
    return " · ".join(parts) or "조건 없음"


def rule_filter(text: str, kind: str = "access") -> LogFilter:
    return LogFilter(active_only=True, log_kind=kind, expr=parse_rule(text, kind).expr)


def view_filter(text: str | None, stored: LogFilter, kind: str = "access") -> LogFilter:
    """The filter of a saved view: its rule, or what was stored with it where the rule doesn't read."""
    try:
        return rule_filter(text, kind) if text else stored
    except RuleError:
        return stored
