"""Token ids in blocks of an adaptive context-mixing range coder.

A file is a run of blocks; each starts from a fresh model, names its documents and carries
checksums, so a block can be read without any other.  In a block the ids are dealt out to
lanes that take their steps together and share one model, one 64-bit range coder a lane.
For each id the model looks up the id that followed the last two ids (order 2) and the last
id (order 1) before, and keeps id frequencies (order 0).  How much of the coder's range each
order gets is mixed from how often it was right at the present confidence of both others.

Defined results: a null text is an empty one, whose only id is the end id; documents are
stored in ascending order of their ids, null first; rows that share an id keep one entry
each, ordered by a hash of their text; an empty table gives no files and no rows.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallylog.llm.common import give_back, let_go, materialise, new_path, text_bytes
from tallylog.llm.word_ids import word_ids

END = 2
#: ids a block holds at most, and ids of a lane at most
BLOCK_IDS, LANE_IDS = 1 << 20, 512
#: blocks of the same size that are coded together
TOGETHER = 6
#: rows of a batch that are taken at once
ROWS = 512
#: the coder's totals: order-0 frequencies, and the shares of the three orders
_FREQ, _SHARE = 20, 12
#: steps between two refreshes of the order-0 frequencies
_REFRESH = 32
_ORDER2 = 18
_MAGIC = b"TLCM"
_HEAD = struct.Struct("<4sIQIIIIII")
_U32, _SHIFT = np.uint64(0xFFFFFFFF), np.uint64(32)
#: multipliers of the hash of two ids, for the later and the earlier one
_FIRST, _SECOND = np.uint32(0x85EBCA6B), np.uint32(0x9E3779B1)


class Model:
    """The predictions that the lanes of one block share; the same calls keep it the same for writer and reader.

    Several blocks may take their steps together, each with tables of its own; ``ids`` has the number of ids of each.
    """

    def __init__(self, ids: int | list[int], lanes: int):
        self.ids = [ids] if isinstance(ids, int) else ids
        blocks, self.none = len(self.ids), max(self.ids)
        #: each block's places in a table by ids: one more than ids, for predicted ones
        self.row = self.none + 1
        self.seen = np.zeros(blocks * self.row, np.int64)
        #: by context of order 1, then by those of order 2, the id that followed and two bits of confidence
        self.next = np.zeros(blocks * (self.row + (1 << _ORDER2)), np.int32)
        #: how often, by block and context, order 2 was right, order 1 was, and neither
        self.hits = np.tile(np.array([[2], [2], [60]], np.int64), (blocks, 1, 32))
        #: where in the range each of the three has its part, and the part's unit
        self.part, self.unit = np.zeros((2, blocks, 3, 32), np.int64)
        self.steps = 0
        # where the tables of each lane's block begin
        block = np.repeat(np.arange(blocks), lanes)
        self.by_id, self.by_hit, self.by_place = block * self.row, block * 96, block << _FREQ
        first = block * (self.row + (1 << _ORDER2))
        self.by_next = np.stack([first, first + self.row])
        self.before = np.repeat(np.array(self.ids, np.uint32), lanes)
        #: the id before that, as the hash of two ids takes it
        self.before2 = self.before * _SECOND
        self.new: list[np.ndarray] = []
        self.refresh()

    def refresh(self) -> None:
        """Order-0 frequencies that add up to 2**_FREQ in each block, at least 1 each."""
        if self.new:
            self.seen += np.bincount(np.concatenate(self.new), minlength=len(self.seen))
            self.new.clear()
        self.freq, self.cut = np.zeros((2, len(self.seen)), np.uint64)
        for k, ids in enumerate(self.ids):
            own = slice(k * self.row, k * self.row + ids)
            seen, spare = self.seen[own], (1 << _FREQ) - ids
            total = int(seen.sum())
            freq = 1 + (seen * spare // total if total else np.zeros(ids, np.int64))
            freq[int(freq.argmax()) if total else 0] += (1 << _FREQ) - int(freq.sum())
            self.freq[own] = freq
            self.cut[own] = np.cumsum(freq) - freq
        # the part of a predicted id is taken once, from its beginning
        self.times = self.freq.copy()
        self.times[self.none :: self.row] = 1
        self.table = None

    def symbols(self) -> np.ndarray:
        """The id at each place of the order-0 ranges, for the reader."""
        if self.table is None:
            ids = np.tile(np.arange(self.row, dtype=np.int32), len(self.ids))
            self.table = np.repeat(ids, self.freq.astype(np.int64))
        return self.table

    def predict(self, n: int) -> None:
        """Look up both orders' ids for the first ``n`` lanes, and the parts of the range by context."""
        if self.steps and self.steps % _REFRESH == 0:
            self.refresh()
        self.steps += 1
        self.n, last = n, self.before[:n]
        pair = last * _FIRST
        pair ^= self.before2[:n]
        pair >>= np.uint32(32 - _ORDER2)
        # both orders are looked up at once
        self.at = np.empty((2, n), np.intp)
        self.at[0], self.at[1] = last, pair
        self.at += self.by_next[:, :n]
        self.had = self.next.take(self.at)
        self.guess, self.sure = self.had >> 2, self.had.astype(np.int8) & np.int8(3)
        context = self.sure[1] << 2 | self.sure[0]
        context <<= 1
        context |= (self.guess[0] == self.guess[1]).view(np.int8)
        self.context = context + self.by_hit[:n]
        self.unit[:, :2] = 1 + self.hits[:, :2] * ((1 << _SHARE) - 3) // self.hits.sum(1, keepdims=True) << _FREQ
        np.cumsum(self.unit[:, :2], axis=1, out=self.part[:, 1:])
        self.unit[:, 2] = (1 << _FREQ + _SHARE) - self.part[:, 2] >> _FREQ

    def interval(self, ids: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of each lane's part of the range, of 2**(_FREQ + _SHARE) in all; ``kind``: 0 where order 2 is right, 1 where order 1 is, else 2."""
        self.which = self.context + (kind << 5)
        own = self.by_id[: self.n] + np.where(kind == 2, ids, np.int32(self.none))
        unit = self.unit.view(np.uint64).take(self.which)
        start = self.cut.take(own)
        start *= unit
        start += self.part.view(np.uint64).take(self.which)
        unit *= self.times.take(own)
        return start, unit

    def update(self, ids: np.ndarray, right: np.ndarray) -> None:
        """Take in the ids of this step; ``right``: where each order's guess is the id."""
        self.hits += np.bincount(self.which, minlength=self.hits.size).reshape(self.hits.shape)
        if self.steps % 64 == 0:
            self.hits = np.maximum(self.hits // 2, 1)
        self.new.append(ids + self.by_id[: self.n])
        # a right guess gains confidence, a wrong one loses it or, if it has none, is replaced
        step = (right & (self.sure < 3)).view(np.int8) - (~right).view(np.int8)
        self.had += step
        np.copyto(self.had, ids << 2, where=(self.sure == 0) > right)
        self.next[self.at] = self.had
        np.multiply(self.before[: self.n], _SECOND, out=self.before2[: self.n])
        self.before[: self.n] = ids


def _lanes(n: int) -> tuple[int, int]:
    """(lanes, steps) for ``n`` ids; lane k has those from k * steps on."""
    lanes = max(1, -(-n // LANE_IDS))
    return lanes, -(-n // lanes)


def _active(count: int, step: int, steps: int, blocks: int) -> int:
    """Lanes that have an id at this step; only blocks whose lanes are all full go together."""
    return blocks * -(-(count - step) // steps)


def encode_ids(ids: np.ndarray, n_ids: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each block, a row of ``ids``: 32-bit words of all lanes, one lane after the other, and the number of words of each."""
    blocks, count = ids.shape
    lanes, steps = _lanes(count)
    if count < lanes * steps:
        ids = np.pad(ids, ((0, 0), (0, lanes * steps - count)))
    model = Model(n_ids, lanes)
    lanes *= blocks
    by_step = np.ascontiguousarray(ids.reshape(lanes, steps).T)
    del ids
    low, wide = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    who, words = [], []

    def shift_out(at: np.ndarray, lead: np.ndarray) -> None:
        who.append(at.astype(np.uint16 if lanes <= 1 << 16 else np.int32))
        words.append((lead >> _SHIFT).astype(np.uint32))

    for step in range(steps):
        n = _active(count, step, steps, blocks)
        now = by_step[step, :n]
        model.predict(n)
        right = model.guess == now
        kind = (np.int8(2) - right[0]) * ~right[1]
        start, size = model.interval(now, kind)
        unit = wide[:n] >> _SHIFT
        start *= unit
        low[:n] += start
        np.multiply(unit, size, out=wide[:n])
        _renormalise(low, wide, n, shift_out)
        model.update(now, right)
    shift_out(np.arange(lanes), low)
    shift_out(np.arange(lanes), low << _SHIFT)
    who, words = np.concatenate(who), np.concatenate(words)
    order = np.argsort(who, kind="stable")
    sizes = np.bincount(who, minlength=lanes).astype(np.uint32).reshape(blocks, -1)
    return list(zip(np.split(words[order], np.cumsum(sizes.sum(1, dtype=np.int64))[:-1]), sizes, strict=True))


def _renormalise(low: np.ndarray, wide: np.ndarray, n: int, shift: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Move out settled leading words; where a carry stays possible, cut the range at the next word's border."""
    open_ = low[:n] + wide[:n]
    open_ ^= low[:n]
    at = np.flatnonzero((open_ <= _U32) | (wide[:n] <= _U32))
    while len(at):
        lead, size = low[at], wide[at]
        short = np.flatnonzero((lead ^ lead + size) > _U32)
        if len(short):
            size[short] = (np.uint64(0) - lead[short]) & _U32
        shift(at, lead)
        lead <<= _SHIFT
        size <<= _SHIFT
        low[at], wide[at] = lead, size
        at = at[((lead ^ lead + size) <= _U32) | (size <= _U32)]


def decode_ids(words: np.ndarray, sizes: np.ndarray, count: int, n_ids: list[int]) -> np.ndarray:
    """The ids of the blocks whose words follow each other, a row each."""
    blocks = len(n_ids)
    lanes, steps = _lanes(count)
    model = Model(n_ids, lanes)
    lanes *= blocks
    ends = np.cumsum(sizes.astype(np.int64))
    at = ends - sizes
    words = np.append(words, np.uint32(0)).astype(np.uint64)
    low, wide = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    code = words[at] << _SHIFT | words[at + 1]
    at += 2
    found = np.zeros((steps, lanes), np.int32)

    def shift_in(who: np.ndarray, _: np.ndarray) -> None:
        place = at[who]
        code[who] = code[who] << _SHIFT | words[np.minimum(place, len(words) - 1)]
        at[who] = place + 1

    for step in range(steps):
        n = _active(count, step, steps, blocks)
        model.predict(n)
        unit = wide[:n] >> _SHIFT
        value = code[:n] - low[:n]
        value //= unit
        np.minimum(value, _U32, out=value)
        second, base = (model.part.view(np.uint64).take(model.context + 32 * k) for k in (1, 2))
        guessed = value < base
        kind = np.int8(2) - guessed - (value < second)
        now = np.where(kind == 0, model.guess[1], model.guess[0])
        none = np.flatnonzero(~guessed)
        place = (value[none] - base[none]) // model.unit.view(np.uint64).take(model.context[none] + 64)
        now[none] = model.symbols().take(np.minimum(place, np.uint64((1 << _FREQ) - 1)).astype(np.intp) + model.by_place[none])
        start, size = model.interval(now, kind)
        start *= unit
        low[:n] += start
        np.multiply(unit, size, out=wide[:n])
        _renormalise(low, wide, n, shift_in)
        model.update(now, model.guess == now)
        found[step, :n] = now
    return np.ascontiguousarray(found.T).reshape(blocks, -1)[:, :count]


@dataclass
class Block:
    doc_ids: list[int | None]
    sizes: np.ndarray
    ids: np.ndarray
    #: the last document goes on in the next block
    goes_on: bool


def pack(block: Block) -> bytes:
    """The bytes of one block: head, checksum of the head and body, documents, lanes."""
    return next(pack_all(iter([block])))


def _together(items: Iterable[object], count: Callable[[object], int]) -> Iterator[list]:
    """Runs of blocks with as many ids, in lanes that are all full."""
    run: list = []
    for item in items:
        n = count(item)
        if run and (len(run) == TOGETHER or n != count(run[0]) or math.prod(_lanes(n)) != n):
            yield run
            run = []
        run.append(item)
    if run:
        yield run


def pack_all(blocks: Iterable[Block]) -> Iterator[bytes]:
    """The bytes of each block; blocks of the same size are coded together."""
    for run in _together(blocks, lambda block: len(block.ids)):
        n_ids = [int(np.max(block.ids)) + 1 for block in run]
        # what is stacked is let go once it is dealt out to the lanes
        coded = encode_ids(np.stack([np.asarray(block.ids, np.int32) for block in run]), n_ids)
        for block, n, (words, lanes) in zip(run, n_ids, coded, strict=True):
            own = np.asarray(block.ids, "<u4")
            docs = zlib.compress(np.array([x or 0 for x in block.doc_ids], np.int64).tobytes() + np.array([x is None for x in block.doc_ids], np.uint8).tobytes() + block.sizes.astype(np.int64).tobytes(), 1)
            body = docs + zlib.compress(lanes.tobytes(), 1)
            split = len(docs)
            body += words.astype("<u4").tobytes()
            head = _HEAD.pack(_MAGIC, len(block.doc_ids), len(own), n, split, len(body) - 4 * len(words), len(words), int(block.goes_on), zlib.crc32(own))
            yield head + struct.pack("<I", zlib.crc32(head + body)) + body


def _bodies(stream: object) -> Iterator[tuple[tuple, bytes]]:
    while head := stream.read(_HEAD.size):
        fields = _HEAD.unpack(head)
        (crc,) = struct.unpack("<I", stream.read(4))
        body = stream.read(fields[5] + 4 * fields[6])
        if fields[0] != _MAGIC or zlib.crc32(head + body) != crc:
            raise ValueError("a block fails its checksum")
        yield fields, body


def unpack(stream: object) -> Iterator[Block]:
    """Blocks of a file; a block that fails a checksum raises ValueError."""
    for run in _together(_bodies(stream), lambda item: item[0][2]):
        lanes = [np.frombuffer(zlib.decompress(body[fields[4] : fields[5]]), np.uint32) for fields, body in run]
        words = [np.frombuffer(body, "<u4", fields[6], fields[5]) for fields, body in run]
        found = decode_ids(np.concatenate(words), np.concatenate(lanes), run[0][0][2], [fields[3] for fields, _ in run])
        for (fields, body), ids in zip(run, found, strict=True):
            _, n_docs, _, _, split, _, _, goes_on, ids_crc = fields
            if zlib.crc32(ids.astype("<u4")) != ids_crc:
                raise ValueError("the ids of a block fail their checksum")
            docs = zlib.decompress(body[:split])
            doc_ids = np.frombuffer(docs, np.int64, n_docs).tolist()
            null = np.frombuffer(docs, np.uint8, n_docs, 8 * n_docs)
            yield Block([None if x else d for d, x in zip(doc_ids, null, strict=True)], np.frombuffer(docs, np.int64, n_docs, 9 * n_docs), ids, bool(goes_on))


def blocks_of(documents: Iterator[tuple[int | None, np.ndarray]], limit: int = BLOCK_IDS) -> Iterator[Block]:
    """Documents in blocks of ``limit`` ids at most; a document may go on in the next block."""
    doc_ids, parts, n = [], [], 0
    for doc_id, ids in documents:
        while n + len(ids) > limit:
            if limit > n:
                doc_ids.append(doc_id)
                parts.append(ids[: limit - n])
            cut, ids = limit > n, ids[limit - n :]
            yield Block(doc_ids, np.array([len(p) for p in parts], np.int64), np.concatenate(parts), cut)
            doc_ids, parts, n = [], [], 0
        doc_ids.append(doc_id)
        parts.append(ids)
        n += len(ids)
    if parts:
        yield Block(doc_ids, np.array([len(p) for p in parts], np.int64), np.concatenate(parts), False)


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if urlparse(path).scheme else f"file://{path}")


def write_ids(df: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode every text, write the blocks in order of the ids below ``path``; one row a file: (part, file, n_docs, n_tokens).

    A task that is run again writes a file of another name; the rows name the files that count.
    """
    slim = df.select(df[id_col].cast("long").alias("doc_id"), text_bytes(df, text_col).alias("text"))
    tie = F.xxhash64("text").alias("tie")
    dealt = slim.select("doc_id", "text", tie).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        context = TaskContext.get()
        words = word_ids(tokenizer)
        stop = np.array([end], np.int32)
        done = [0, 0]

        def documents() -> Iterator[tuple[int | None, np.ndarray]]:
            for batch in rows:
                for k in range(0, batch.num_rows, ROWS):
                    doc_ids, texts = (column.to_pylist() for column in batch.slice(k, ROWS).columns)
                    for doc_id, own in zip(doc_ids, words.encode(texts), strict=True):
                        done[0] += 1
                        done[1] += len(own) + 1
                        yield doc_id, np.concatenate([own, stop])

        store, folder = _store(path)
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.ids"
        out = None
        for packed in pack_all(blocks_of(documents(), block_ids)):
            if out is None:
                store.create_dir(folder, recursive=True)
                out = store.open_output_stream(f"{folder}/{name}")
            out.write(packed)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [context.partitionId()], "file": [f"{path}/{name}"], "n_docs": [done[0]], "n_tokens": [done[1]]}, pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return materialise(dealt.select("doc_id", "text").mapInArrow(each, "part int, file string, n_docs long, n_tokens long"), "id-files")


def read_ids(files: DataFrame) -> DataFrame:
    """Per document of the files that ``write_ids`` names: (doc_id, start, n_tokens, ids_crc32)."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    at = files.select("part", "file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("first"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in rows:
            for row in batch.to_pylist():
                store, where = _store(row["file"])
                start, open_doc = row["first"], None
                with store.open_input_stream(where) as stream:
                    for block in unpack(stream):
                        data = memoryview(block.ids.astype("<u4").tobytes())
                        out, k = [], 0
                        for doc_id, size in zip(block.doc_ids, block.sizes.tolist(), strict=True):
                            n, crc = open_doc or (0, 0)
                            open_doc = (n + size, zlib.crc32(data[4 * k : 4 * (k + size)], crc))
                            k += size
                            if not (block.goes_on and k == len(block.ids)):
                                out.append((doc_id, start, *open_doc))
                                start += open_doc[0]
                                open_doc = None
                        yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*out, strict=True)), strict=True)) if out else {n: [] for n in schema.names}, schema)

    tasks = max(1, files.count())
    return at.repartition(tasks, "part").mapInArrow(each, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_ids(df: DataFrame, tokenizer: str, **options: object) -> DataFrame:
    """Write all documents as id files in the shared folder and list the documents as read back."""
    return read_ids(write_ids(df, tokenizer, new_path(df.sparkSession, "ids"), **options))
