"""Conditions on log rows: a filter record and a condition tree, compiled to one Column.

NULL follows SQL: a condition on a missing value is unknown and drops the row, also under
``Not``.  Values are checked before any Column is built and never repeated in an error.
"""

from __future__ import annotations

import functools
import hashlib
import json
import operator
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylog.functions.regex_dialect import to_java
from tallylog.plans.schema import EXPR_DEPTH, EXPR_NODES, VALUE_BYTES

#: fixed values: the fields of conditions and the columns behind them, and the operators
FIELDS = ("status", "bytes_sent", "method", "client_ip", "request_target", "protocol", "referrer", "user_agent", "extra", "level", "message")
NUMERIC = ("status", "bytes_sent")
ORDER = {"gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}
OPS = ("eq", "ne", *ORDER, "contains", "icontains", "starts_with", "ends_with", "regex", "is_null")


class FilterError(ValueError):
    pass


@dataclass(frozen=True)
class Cond:
    field: str
    op: str
    value: str = ""


@dataclass(frozen=True)
class And:
    items: tuple = ()


@dataclass(frozen=True)
class Or:
    items: tuple = ()


@dataclass(frozen=True)
class Not:
    item: object = None


@dataclass(frozen=True)
class Always:
    pass


Expr = Cond | And | Or | Not | Always


@dataclass(frozen=True)
class LogFilter:
    job_id: int | None = None
    source_id: int | None = None
    active_only: bool = False
    log_kind: str | None = None
    time_from: int | None = None
    time_to: int | None = None
    status: int | None = None
    status_class: int | None = None
    client_ip: str | None = None
    method: str | None = None
    target_contains: str | None = None
    target_regex: str | None = None
    bookmarked_only: bool = False
    expr: Expr | None = field(default=None)

    def digest(self) -> str:
        """Tells filters apart; a cursor is good for the filter it was made with only."""
        return hashlib.sha256(json.dumps([asdict(self), repr(self.expr)], sort_keys=True, default=repr).encode()).hexdigest()


def checked_text(value: str) -> str:
    if len(value.encode()) > VALUE_BYTES:
        raise FilterError(f"a value is over {VALUE_BYTES} bytes")
    return value


def checked_number(value: str) -> int:
    text = value.strip()
    if not text.lstrip("+-").isdigit() or not -(2**63) <= int(text) < 2**63:
        raise FilterError("a numeric field needs an integer")
    return int(text)


def field_column(name: str) -> Column:
    if name in ("level", "message"):
        return F.get_json_object("extra_json", f"$.{name}")
    return F.col("extra_json" if name == "extra" else name)


def size_of(expr: Expr, depth: int = 1) -> int:
    """Nodes of the tree; too deep or too large a tree is refused."""
    if depth > EXPR_DEPTH:
        raise FilterError(f"a condition is nested over {EXPR_DEPTH} levels")
    below = expr.items if isinstance(expr, And | Or) else (expr.item,) if isinstance(expr, Not) else ()
    total = 1
    for x in below:
        total += size_of(x, depth + 1)
        if total > EXPR_NODES:
            raise FilterError(f"a condition has over {EXPR_NODES} parts")
    return total


def expr_column(expr: Expr) -> Column:
    size_of(expr)
    return _column(expr)


def _column(expr: Expr) -> Column:
    match expr:
        case Always() | And(()) | Or(()):
            return F.lit(True)
        case And(items):
            return functools.reduce(operator.and_, map(_column, items))
        case Or(items):
            return functools.reduce(operator.or_, map(_column, items))
        case Not(item):
            return ~_column(item)
    if expr.field not in FIELDS or expr.op not in OPS:
        raise FilterError("an unknown field or operator")
    col, value = field_column(expr.field), checked_text(expr.value)
    if expr.op == "is_null":
        return col.isNull()
    if expr.field in NUMERIC:
        if expr.op not in ("eq", "ne", *ORDER):
            raise FilterError("a numeric field can only be compared")
        number = F.lit(checked_number(value))
        return {"eq": operator.eq, "ne": operator.ne, **ORDER}[expr.op](col, number)
    match expr.op:
        case "eq":
            return col == value
        case "ne":
            return col != value
        case "contains":
            return col.contains(value)
        case "icontains":
            return F.lower(col).contains(F.lower(F.lit(value)))
        case "starts_with":
            return col.startswith(value)
        case "ends_with":
            return col.endswith(value)
        case "regex":
            return col.rlike(to_java(value))
    raise FilterError("a text field can't be ordered")


def row_conditions(f: LogFilter) -> list[Column]:
    """The conditions that need no other table."""
    found = []
    for name in ("job_id", "source_id", "status", "client_ip", "method"):
        if (value := getattr(f, name)) is not None:
            found.append(F.col(name) == value)
    if f.time_from is not None:
        found.append(F.col("timestamp_utc") >= F.timestamp_micros(F.lit(f.time_from)))
    if f.time_to is not None:
        found.append(F.col("timestamp_utc") < F.timestamp_micros(F.lit(f.time_to)))
    if f.status_class is not None:
        if not 1 <= f.status_class <= 5:
            raise FilterError("status classes are 1 to 5")
        found += [F.col("status") >= f.status_class * 100, F.col("status") < (f.status_class + 1) * 100]
    if f.target_contains is not None:
        found.append(F.col("request_target").contains(checked_text(f.target_contains)))
    if f.target_regex is not None:
        found.append(F.col("request_target").rlike(to_java(checked_text(f.target_regex))))
    if f.expr is not None:
        found.append(expr_column(f.expr))
    return found


def apply_filter(logs: DataFrame, f: LogFilter, jobs: DataFrame | None = None, bookmarks: DataFrame | None = None) -> DataFrame:
    """Rows of ``logs`` that meet ``f``; jobs and bookmarks come in as semi-joins on their keys."""
    for condition in row_conditions(f):
        logs = logs.where(condition)
    if f.active_only:
        logs = logs.join(jobs.where("active").select("job_id"), "job_id", "left_semi")
    if f.log_kind is not None:
        logs = logs.join(jobs.where(F.coalesce("log_kind", F.lit("access")) == f.log_kind).select("job_id"), "job_id", "left_semi")
    if f.bookmarked_only:
        logs = logs.join(bookmarks.select("source_id", "line_number"), ["source_id", "line_number"], "left_semi")
    return logs


def frozen(logs: DataFrame, max_batch: int) -> DataFrame:
    """Only batches committed when the reading began."""
    return logs.where(F.col("batch_id") <= max_batch)


def with_scope(f: LogFilter, time_from: int | None = None, time_to: int | None = None, whitelist: Iterable[str] = ()) -> LogFilter:
    """``f`` within a period and without the listed addresses; ``10.0.*`` lists all that begin so.

    Under SQL's rules a row without an address drops out as soon as a list is given.
    """
    known = [Cond("client_ip", "starts_with", x[:-1]) if x.endswith("*") else Cond("client_ip", "eq", x) for x in whitelist]
    parts = [x for x in (f.expr,) if x is not None] + ([Not(Or(tuple(known)))] if known else [])
    return replace(f, time_from=time_from if time_from is not None else f.time_from, time_to=time_to if time_to is not None else f.time_to, expr=And(tuple(parts)) if len(parts) > 1 else parts[0] if parts else None)


def quick_access(text: str) -> Expr:
    return Or((Cond("request_target", "icontains", text), Cond("client_ip", "eq", text), Cond("referrer", "icontains", text), Cond("user_agent", "icontains", text)))


def quick_error(text: str) -> Expr:
    return Or((Cond("message", "icontains", text), Cond("client_ip", "eq", text)))


def bookmark_filter(f: LogFilter) -> LogFilter:
    """The rule of ``f`` over bookmarked rows of any kind."""
    return replace(f, log_kind=None, bookmarked_only=True)
