"""Lines of log files by stated byte ranges, as a data source.

A span is a range of one file's bytes, unpacked; a line belongs to the span in which it begins,
so spans may be cut anywhere and read by any tasks, and which lines each has doesn't depend on
how many cores there are.  A first look counts the lines of every span, and notes the last
W3C header in it; sums over the spans then number the lines, carry the headers forward, and
tell how many lines a reader has to come up with.

Gzip files are unpacked from the start of a member.  The first look at one notes where its
members begin, so the members of a file are read by many tasks, and a later run starts at the
member that it needs.

Files are opened where the tasks run, so folders have to be mounted there.
"""

from __future__ import annotations

import base64
import gzip
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallylog.plans.schema import LINE_BYTES, W3C_FIELDS

#: bytes of a span at least and at most, and what opening a file counts as where small ones are read together
SPAN_LEAST, SPAN_MOST, OPEN_BYTES = 4 << 20, 64 << 20, 256 << 10
#: bytes that are read at a time
BLOCK = 4 << 20
#: of a longer line no more is kept, which tells that it is too long
KEPT = LINE_BYTES + 1
_BOM = b"\xef\xbb\xbf"
_GAP = re.compile(r"[ \t\r\n\f]+")
LINES = "source_id long, line_number long, bytes binary, start_offset long, next_offset long, header string"
COUNTS = "source_id long, physical long, at long, low long, high long, lines long, header string"


@dataclass(frozen=True)
class Span:
    """Lines that begin at ``low`` or later and before ``high``, in unpacked bytes."""

    source_id: int
    path: str
    packed: bool
    #: where in the file reading starts, and which unpacked byte that is
    physical: int
    at: int
    low: int
    high: int
    #: number of lines before the span, of its own, and the header that holds at its beginning
    before: int = 0
    lines: int = 0
    header: str | None = None
    #: the header that holds at its end
    last: str | None = None


def fields_of(line: bytes) -> str | None:
    """The names of a ``#Fields:`` line with one space between them; None if the line names none or too many."""
    if len(line) > LINE_BYTES or not line.startswith(b"#Fields:"):
        return None
    try:
        names = [x for x in _GAP.split(line.decode()[8:]) if x]
    except UnicodeDecodeError:
        return None
    return " ".join(names) if 1 <= len(names) <= W3C_FIELDS else None


def _opened(span: Span) -> BinaryIO:
    stream = open(span.path, "rb")
    stream.seek(span.physical)
    return gzip.GzipFile(fileobj=stream) if span.packed else stream


def line_blocks(stream: BinaryIO, at: int, low: int, high: int) -> Iterator[tuple[list[bytes] | pa.Array, np.ndarray, np.ndarray]]:
    """(lines, where each begins, where the next one does) of a stream whose first byte is number ``at``; a line begins at ``at`` if ``at`` is ``low``.

    No more of a line than KEPT bytes is held.
    """
    position, rest, dropped = at, b"", 0  # ``dropped``: bytes of the unfinished line that aren't held
    begins = at == low  # whether a line begins at the position where ``rest`` does
    while True:
        start = position - len(rest) - dropped
        if start >= high and begins:
            return
        data = stream.read(BLOCK)
        position += len(data)
        if not begins:
            # look for the first line that begins at ``low`` or later
            while data and not begins:
                base = position - len(data)
                cut = data.find(b"\n", max(0, low - 1 - base))
                if cut >= 0 and base + cut + 1 >= low:
                    data, begins = data[cut + 1 :], True
                elif position >= high:
                    return
                else:
                    data = stream.read(BLOCK)
                    position += len(data)
            if not begins:
                return
            start = position - len(data)
            if start >= high:
                return
            if not data:
                continue
        if not data:
            if rest or dropped:
                yield [rest], np.array([start]), np.array([position])
            return
        last = data.rfind(b"\n")
        if last < 0:
            rest += data
            if len(rest) > KEPT:
                dropped += len(rest) - KEPT
                rest = rest[:KEPT]
            continue
        whole = rest + data[:last]
        ends = position - len(data) + np.flatnonzero(np.frombuffer(data, np.uint8, last + 1) == 10) + 1
        starts = np.append(start, ends[:-1])
        lines = pc.split_pattern(pa.scalar(whole, pa.binary()), b"\n").values
        if dropped or (ends - starts).max() > KEPT:
            lines = [x[:KEPT] for x in lines.to_pylist()]
        n = int(np.searchsorted(starts, high))
        yield lines[:n], starts[:n], ends[:n]
        if n < len(starts):
            return
        rest, dropped = data[last + 1 :], 0
        if len(rest) > KEPT:
            dropped, rest = len(rest) - KEPT, rest[:KEPT]


def read_span(span: Span, headers: bool) -> Iterator[pa.RecordBatch]:
    number, header = span.before, span.header
    with _opened(replace_low(span)) as stream:
        for lines, starts, ends in line_blocks(stream, *_window(span)):
            n = len(lines)
            if not n:
                continue
            if starts[0] == 0:
                first = lines[0] if isinstance(lines, list) else lines[0].as_py()
                if first.startswith(_BOM):
                    lines = [first[3:], *(lines[1:] if isinstance(lines, list) else lines[1:].to_pylist())]
            told = pa.nulls(n, pa.string())
            if headers:
                held = lines if isinstance(lines, list) else lines.to_pylist()
                states = []
                for line in held:
                    if line.startswith(b"#Fields:"):
                        header = fields_of(line) or header
                    states.append(header)
                told = pa.array(states, pa.string())
            for k in range(0, n, 1 << 16):
                part = slice(k, k + (1 << 16))
                own = lines[part]
                size = len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(size, span.source_id)), pa.array(np.arange(number + 1, number + 1 + size)), own if isinstance(own, pa.Array) else pa.array(own, pa.binary()), pa.array(starts[part]), pa.array(ends[part]), told.slice(k, size)],
                    names=["source_id", "line_number", "bytes", "start_offset", "next_offset", "header"],
                )
                number += size
    if number - span.before != span.lines:
        raise ValueError(f"source {span.source_id} has changed: {number - span.before} lines from byte {span.low}, not {span.lines}")


def replace_low(span: Span) -> Span:
    """A plain file is read from the byte before its span, which tells whether a line begins there."""
    return span if span.packed or not span.low else replace(span, physical=span.low - 1)


def _window(span: Span) -> tuple[int, int, int]:
    at = span.at if span.packed else max(0, span.low - 1)
    return at, span.low, span.high


def count_span(span: Span, headers: bool) -> dict:
    """How many lines begin in a span of a plain file, and the last header among them."""
    n, header = int(span.low == 0 and span.high > 0), None
    if headers:
        n = 0
        with _opened(replace_low(span)) as stream:
            for lines, starts, _ in line_blocks(stream, *_window(span)):
                held = lines if isinstance(lines, list) else lines.to_pylist()
                if held and starts[0] == 0:
                    held[0] = held[0].removeprefix(_BOM)
                n += len(held)
                for line in held:
                    if line.startswith(b"#Fields:"):
                        header = fields_of(line) or header
    else:
        # a line begins after every line end that isn't the file's last byte; ``high`` is the file's size at most
        with _opened(replace_low(span)) as stream:
            left = span.high - 1 - max(0, span.low - 1)
            while left > 0 and (data := stream.read(min(BLOCK, left))):
                n += data.count(b"\n")
                left -= len(data)
    return {"source_id": span.source_id, "physical": span.physical, "at": span.at, "low": span.low, "high": span.high, "lines": n, "header": header}


def _members(stream: BinaryIO, physical: int) -> Iterator[tuple[int, bytes]]:
    """(where the member begins, unpacked bytes) of a gzip file, piece by piece."""
    made, member, data = None, physical, b""
    while True:
        if not data:
            data = stream.read(1 << 20)
            if not data:
                if made is not None:
                    raise EOFError("the file ends within a gzip member")
                return
        if made is None:
            # zeros may fill up the end of a file
            data = data.lstrip(b"\0")
            if not data:
                continue
            made, member = zlib.decompressobj(31), stream.tell() - len(data)
        while data:
            piece = made.decompress(data, BLOCK)
            data = made.unconsumed_tail
            if piece:
                yield member, piece
            if made.eof:
                data, made = made.unused_data, None
                break


def count_packed(span: Span, headers: bool, least: int) -> Iterator[dict]:
    """The spans of a gzip file, each of ``least`` unpacked bytes or more and read from a member's start on, with their lines and last headers.

    A span begins where the first line within its first member does; the line that goes on
    over the member's start belongs to the span before.
    """
    with open(span.path, "rb") as stream:
        stream.seek(span.physical)
        own = {"source_id": span.source_id, "physical": span.physical, "at": span.at, "low": span.at, "lines": 0, "header": None}
        position, tail, latest, next_at = span.at, b"", span.physical, None

        def take(piece: bytes) -> None:
            nonlocal tail
            own["lines"] += piece.count(b"\n")
            if headers:
                *whole, tail = (tail + piece).split(b"\n")
                for line in whole:
                    if line.startswith(b"#Fields:"):
                        own["header"] = fields_of(line) or own["header"]
                tail = tail[:KEPT]

        last = b"\n"
        for member, piece in _members(stream, span.physical):
            if member != latest:
                latest = member
                if position - own["low"] >= least:
                    next_at = position
            if headers and position == 0:
                # a mark of byte order isn't part of the first line; a piece holds more than it
                tail, position, piece = b"", len(_BOM) * piece.startswith(_BOM), piece.removeprefix(_BOM)
            cut = piece.find(b"\n") + 1
            # a line that begins at the member's start can't be told from one that goes on, but by the byte before
            if next_at is not None and (last == b"\n" and next_at == position or cut):
                cut = 0 if last == b"\n" and next_at == position else cut
                take(piece[:cut])
                yield own | {"high": position + cut}
                own = {"source_id": span.source_id, "physical": latest, "at": next_at, "low": position + cut, "lines": 0, "header": None}
                take(piece[cut:])
                next_at = None
            else:
                take(piece)
            position += len(piece)
            last = piece[-1:] or last
        if last != b"\n":
            own["lines"] += 1
            if headers:
                own["header"] = fields_of(tail) or own["header"]
        yield own | {"high": position}


class _Work(InputPartition):
    def __init__(self, spans: list[dict]):
        self.spans = spans


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        held = json.loads(zlib.decompress(base64.b64decode(self.options["work"])))
        return [_Work(spans) for spans in held]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        headers, least = self.options["headers"] == "true", int(self.options["least"])
        for made in partition.spans:
            span = Span(**made)
            if self.options["mode"] == "lines":
                yield from read_span(span, headers)
            else:
                rows = list(count_packed(span, headers, least)) if span.packed else [count_span(span, headers)]
                names = [x.split()[0] for x in COUNTS.split(", ")]
                yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], pa.schema([(n, pa.string() if n == "header" else pa.int64()) for n in names]))


class LogRanges(DataSource):
    """``spark.read.format("tallylog_ranges")``: stated spans of log files, as counts or as lines."""

    @classmethod
    def name(cls) -> str:
        return "tallylog_ranges"

    def schema(self) -> str:
        return LINES if self.options["mode"] == "lines" else COUNTS

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(dict(self.options))


def _load(spark: SparkSession, spans: list[Span], mode: str, headers: bool, least: int, together: int) -> DataFrame:
    spark.dataSource.register(LogRanges)
    work: list[list[dict]] = []
    used = together
    for span in spans:
        size = span.high - span.low + OPEN_BYTES
        if used + size > together:
            work.append([])
            used = 0
        work[-1].append(asdict(span))
        used += size
    packed = base64.b64encode(zlib.compress(json.dumps(work).encode())).decode()
    return spark.read.format("tallylog_ranges").options(mode=mode, work=packed, headers=str(headers).lower(), least=str(least)).load()


@dataclass(frozen=True)
class Start:
    """Where to go on in a source: unpacked bytes and lines that are done, and the header that holds."""

    offset: int = 0
    line: int = 0
    header: str | None = None


def span_bytes(spark: SparkSession, total: int) -> int:
    """Bytes of a span: small inputs are dealt to all cores, large ones in spans of SPAN_MOST."""
    return max(SPAN_LEAST, min(SPAN_MOST, total // (2 * spark.sparkContext.defaultParallelism) + 1))


def cut(spans: list[Span], size: int) -> list[Span]:
    """Plain files in spans of ``size`` bytes; packed ones as they are."""
    found = []
    for s in spans:
        if s.packed or s.high - s.low <= size:
            found.append(s)
        else:
            found += [replace(s, low=low, high=min(s.high, low + size), physical=low, at=low) for low in range(s.low, s.high, size)]
    return found


def counted(spark: SparkSession, spans: list[Span], starts: dict[int, Start], headers: bool, size: int) -> list[Span]:
    """``spans`` (of one source in order, from where it starts) numbered; packed files in as many spans as their members allow."""
    paths = {s.source_id: s for s in spans}
    told = _load(spark, spans, "counts", headers, size, size + OPEN_BYTES).collect() if spans else []
    rows = sorted(told, key=lambda r: (r["source_id"], r["low"]))
    return numbered([Span(r["source_id"], paths[r["source_id"]].path, paths[r["source_id"]].packed, r["physical"], r["at"], r["low"], r["high"], 0, r["lines"], r["header"]) for r in rows], starts)


def numbered(spans: list[Span], starts: dict[int, Start]) -> list[Span]:
    """Spans with the lines before each and the header that holds at its beginning, where ``header`` was the last one within it."""
    found, at = [], {}
    for s in spans:
        line, header = at.get(s.source_id) or ((started := starts.get(s.source_id, Start())).line, started.header)
        found.append(replace(s, before=line, header=header, last=s.header or header))
        at[s.source_id] = (line + s.lines, s.header or header)
    return found


def lines_of(spark: SparkSession, spans: list[Span], headers: bool, size: int) -> DataFrame:
    """The lines of numbered spans: LINES."""
    return _load(spark, [s for s in spans if s.lines], "lines", headers, size, size + OPEN_BYTES)
