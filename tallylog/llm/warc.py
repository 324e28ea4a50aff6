"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

Files are runs of gzip members of one or more records, or plain records.  The reader takes a
record only after its checks hold (gzip's own checksum, the length, the block digest, and
the payload digest of a response).  After a failed check it searches for the next valid
start, a gzip member that opens with a WARC version line or such a line itself, goes on
there and logs the bytes between as a quarantined gap.

Defined results: a null payload is an empty one; of rows with equal payloads of at least
100 bytes the one with the smallest id is the response and the others revisit it, all rows
with that smallest id being responses; smaller payloads are never revisited; a null id is
written as an empty one, is never referred to while its payload has another id, and comes
back as null; other columns, whatever their names, aren't looked at; an empty table gives no
files and no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylog.llm.common import materialise, new_path, text_bytes

LEAST = 100
#: a file is closed once it holds this many bytes, which bounds what a reading task holds
ROLL_BYTES = 64 << 20
#: a member that unpacks to more is not read but logged
MEMBER_BYTES = 1 << 30
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VERSION, _GZIP, _END = b"WARC/1.1", b"\x1f\x8b\x08", b"\r\n\r\n"
_LINE = re.compile(rb"WARC/[0-9]+\.[0-9]+\r\n")


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "")


@dataclass
class Salvage:
    """Records in order, and (start, end, reason) of the bytes that hold none."""

    records: list[Record] = field(default_factory=list)
    gaps: list[tuple[int, int, str]] = field(default_factory=list)


def digest_of(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def record_bytes(kind: str, page: str, uri: str | None, payload: bytes, digest: str, size: int, refers: str | None = None, compress: bool = True) -> bytes:
    """One record; a revisit keeps the payload's digest and size but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(size).encode() + _END
    block = http + (b"" if kind == "revisit" else payload)
    lines = [
        f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {percent(uri or '')}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", f"WARC-Block-Digest: {digest_of(block)}",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers}>"]
    whole = _VERSION + b"\r\n" + "\r\n".join(lines).encode() + _END + block + _END
    if not compress:
        return whole
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(whole) + packer.flush()


def percent(uri: str) -> str:
    """The address on one line: control characters and blanks as percent codes."""
    return "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in uri)


def parse(data: bytes, at: int = 0) -> tuple[Record, int]:
    """The plain record that begins at ``at`` and where it ends; ValueError where a check fails."""
    if not _LINE.match(data, at):
        raise ValueError("no version line")
    end = data.find(_END, at)
    if end < 0:
        raise ValueError("the header doesn't end")
    headers = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("a header line without a colon")
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = headers.get("content-length", "")
    if not length.isdigit():
        raise ValueError("no length")
    first, last = end + 4, end + 4 + int(length)
    if data[last : last + 4] != _END:
        raise ValueError("the block doesn't end where its length says")
    block = data[first:last]
    for name, part in (("warc-block-digest", block), ("warc-payload-digest", block.partition(_END)[2])):
        if name == "warc-payload-digest" and headers.get("warc-type") != "response":
            continue
        if (told := headers.get(name)) and not matches(told, part):
            raise ValueError(f"{name} doesn't hold")
    return Record(headers, block), last + 4


def matches(told: str, part: bytes) -> bool:
    """Whether a digest header holds; hexadecimal or base 32, unknown algorithms pass."""
    name, _, value = told.partition(":")
    if name.lower() not in ("sha1", "sha256", "md5"):
        return True
    made = hashlib.new(name.lower(), part)
    return value.lower() == made.hexdigest() or value.upper() == base64.b32encode(made.digest()).decode()


def inflate(data: bytes, at: int, most: int = MEMBER_BYTES) -> tuple[bytes, int]:
    """Contents of the gzip member at ``at`` and where it ends; its checksum is checked."""
    opened = zlib.decompressobj(31)
    parts, k, size = [], at, 0
    while not opened.eof:
        piece = opened.unconsumed_tail
        if not piece:
            piece = data[k : k + (1 << 20)]
            k += len(piece)
        parts.append(opened.decompress(piece, 1 << 22))
        if not piece and not parts[-1] and not opened.eof:
            raise ValueError("the member is cut short")
        size += len(parts[-1])
        if size > most:
            raise ValueError("the member unpacks to too many bytes")
    return b"".join(parts), k - len(opened.unused_data)


def opens(data: bytes, at: int) -> bool:
    """Whether a member at ``at`` begins with a version line; only its first bytes are unpacked."""
    try:
        return zlib.decompressobj(31).decompress(data[at : at + 4096], 5) == b"WARC/"
    except zlib.error:
        return False


def next_start(data: bytes, at: int) -> int:
    """The next place that opens like a record, or the end."""
    line, member = _LINE.search(data, at), data.find(_GZIP, at)
    plain = line.start() if line else -1
    while member >= 0 and (plain < 0 or member < plain):
        if opens(data, member):
            return member
        member = data.find(_GZIP, member + 1)
    return plain if plain >= 0 else len(data)


def salvage(data: bytes) -> Salvage:
    """All records of a file that can be read, and the gaps between them."""
    found, at, bad, why = Salvage(), 0, -1, ""
    while at < len(data):
        try:
            if data.startswith(_GZIP, at):
                try:
                    whole, end = inflate(data, at)
                except zlib.error as error:
                    raise ValueError(str(error)) from error
                records, used = [], 0
                while used < len(whole):
                    record, used = parse(whole, used)
                    records.append(record)
            else:
                record, end = parse(data, at)
                records = [record]
        except ValueError as error:
            if bad < 0:
                bad, why = at, str(error)
            at = next_start(data, at + 1)
            continue
        if bad >= 0:
            found.gaps.append((bad, at, why))
            bad = -1
        found.records += records
        at = end
    if bad >= 0:
        found.gaps.append((bad, len(data), why))
    return found


def store_of(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if urlparse(path).scheme else f"file://{path}")


def with_kinds(df: DataFrame, id_col: str, url_col: str, body_col: str, least: int = LEAST) -> DataFrame:
    """(page_id, url, body, digest, first_id): the id that a body of at least ``least`` bytes is kept under, where there is another.

    Only digests that occur under more than one id are joined back.
    """
    pages = df.select(df[id_col].cast("long").alias("page_id"), df[url_col].cast("string").alias("url"), text_bytes(df, body_col).alias("body"))
    digests = df.select(df[id_col].cast("long").alias("page_id"), F.sha2(text_bytes(df, body_col), 256).alias("digest"), F.octet_length(text_bytes(df, body_col)).alias("size"))
    several = digests.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    several = materialise(several.where("n > 1").select(F.col("digest").alias("_digest"), "first_id"), "digests")
    pages = pages.withColumn("digest", F.sha2("body", 256))
    return pages.join(several, pages["digest"] == several["_digest"], "left").drop("_digest")


def write_warc(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", compress: bool = True, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write a record for each row below ``path``; one row a file: (file, records).

    A task that is run again writes files of other names; the rows name those that count.
    """

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, store, folder, out, made = TaskContext.get(), None, "", None, []
        suffix = "warc.gz" if compress else "warc"
        for batch in rows:
            for page, url, body, digest, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    store, folder = store_of(path)
                    store.create_dir(folder, recursive=True)
                    name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{len(made):04d}.{suffix}"
                    out = store.open_output_stream(f"{folder}/{name}", compression=None)
                    made.append([f"{path}/{name}", 0])
                again = first is not None and page != first
                out.write(record_bytes("revisit" if again else "response", "" if page is None else str(page), url, body, digest, len(body), str(first) if again else None, compress))
                made[-1][1] += 1
                if out.tell() >= roll_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made]), pa.array([m[1] for m in made], pa.int64())], names=["file", "records"])

    return materialise(with_kinds(df, id_col, url_col, body_col).select("page_id", "url", "body", "digest", "first_id").mapInArrow(each, "file string, records long"), "warc-files")


RECORD = "file string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, gap_start long, gap_end long, gap_reason string"


def read_warc(files: DataFrame, payloads: bool = True) -> DataFrame:
    """A row for each record of the files named in column ``file``, and one for each gap (record_type null)."""

    def number(urn: str) -> int | None:
        tail = urn.strip("<>").rpartition(":")[2]
        return int(tail) if tail.lstrip("-").isdigit() else None

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in RECORD.split(", "))])
        for batch in rows:
            for file in batch.column(0).to_pylist():
                store, where = store_of(file)
                with store.open_input_stream(where, compression=None) as stream:
                    got = salvage(stream.read())
                out = []
                for r in got.records:
                    payload = r.block.partition(_END)[2]
                    told = r.headers.get("x-payload-length", "")
                    digest = r.headers.get("warc-payload-digest", digest_of(payload)).partition(":")[2]
                    again = r.kind == "revisit"
                    out.append((file, number(r.headers.get("warc-record-id", "")), r.headers.get("warc-target-uri"), r.kind, int(told) if again and told.isdigit() else len(payload), digest, number(r.headers.get("warc-refers-to", "")) if again else None, payload if payloads else None, None, None, None))
                out += [(file, *[None] * 7, a, b, why) for a, b, why in got.gaps]
                for k in range(0, len(out), 512):
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True)) for row in out[k : k + 512]], schema)

    tasks = max(1, files.count())
    return files.select("file").repartition(tasks, "file").mapInArrow(each, RECORD)


def archive_report(df: DataFrame, **columns: str) -> DataFrame:
    """Write all pages as archives in the shared folder and list the records as read back."""
    found = read_warc(write_warc(df, new_path(df.sparkSession, "warc"), **columns), payloads=False)
    # what was just written has no gaps; a page that can't be read back is an error, not a row less
    damage = F.raise_error(F.concat(F.lit("a gap in "), "file", F.lit(": "), "gap_reason"))
    page = F.when(F.col("record_type").isNull(), damage.cast("long")).otherwise(F.col("page_id"))
    return found.select(page.alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
