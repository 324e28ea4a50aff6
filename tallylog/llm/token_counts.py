"""Token counts by a compiled tokenizer: chunk state maps, composed by parallel prefix scan.

Texts become symbols (bytes, the last one of a word marked) and are cut into chunks of fixed
size, wherever the cut falls.  A chunk's map is a table: entry state to exit state and number
of tokens.  No chunk waits for the one before.  One that begins with a word has one row,
whatever the state before; for one that goes on with a word the states that it may be entered
in are told by the few symbols before the cut: from where the word begins, or, if that is
more than LOOK symbols back, from several places there, each of which may give a state of its
own and so a row.  Only where a table's exit still isn't an entry of the next chunk's table,
which takes a long word without a blank, a row for it is added.  Maps compose associatively, and a scan of logarithmic depth composes them for all prefixes of all texts of
a piece at once; the map of a whole text, applied to the start state, has its count.

Parts between white space that hold a character other than ASCII and the letters of U+00C0
to U+00FF, or the string of a special token, are counted by the tokenizers library, part by
part; they begin and end in the start state and add to their chunk's row.

Defined results: a null text is an empty one, with zero tokens; rows are independent, so
repeated rows, ties and extra columns, whatever their names, change nothing; texts of any
length are run in pieces of bounded size; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylog.llm.bpe_machine import BpeMachine, machine
from tallylog.llm.common import text_bytes
from tallylog.llm.word_symbols import pieces, symbols_of

CHUNK_BYTES = 1 << 12
LIMIT = 2048
#: symbols before a cut that are looked at, and places among them from which a longer word is followed
LOOK, PLACES = 48, 4
#: entry of a row that holds whatever the state before
ANY = -1


@dataclass
class Maps:
    """Tables of several chunks; rows sorted by chunk and entry state."""

    chunk: np.ndarray
    entry: np.ndarray
    exit: np.ndarray
    count: np.ndarray

    def rows(self, chunk: np.ndarray, state: np.ndarray) -> np.ndarray:
        """The row that each chunk has for the state."""
        keys = self.chunk << 32 | self.entry + 1
        at = np.minimum(np.searchsorted(keys, chunk << 32 | state + 1), len(keys) - 1)
        missed = keys[at] != (chunk << 32 | state + 1)
        at[missed] = np.minimum(np.searchsorted(keys, chunk[missed] << 32 | ANY + 1), len(keys) - 1)
        if (self.chunk[at] != chunk).any() or (self.entry[at[missed]] != ANY).any():
            raise ValueError("a chunk has no row for a state that it is entered in")
        return at


def chunk_maps(parts: list[bytes], bpe: BpeMachine, size: int = CHUNK_BYTES) -> tuple[Maps, np.ndarray]:
    """The maps of all chunks of ``parts``, and the number of chunks up to each part."""
    symbols, word, begin, foreign = symbols_of(parts, bpe.library.special)
    held = np.maximum(1, -(-np.array([len(p) for p in parts], np.int64) // size))
    upto = np.append(0, np.cumsum(held))
    edge = np.repeat(begin, held) + size * (np.arange(upto[-1]) - np.repeat(upto[:-1], held))
    cut = np.zeros(len(symbols), bool)
    cut[edge] = True
    there = symbols >= 0
    starts = np.flatnonzero(there & (word | cut))
    # a run ends before the next one, or at the first gap
    ends = np.flatnonzero(there & ~np.append(there[1:] & ~(word | cut)[1:], False)) + 1
    owner = np.searchsorted(edge, starts, side="right") - 1
    sizes, goes_on = ends - starts, ~word[starts]
    open_end = symbols[ends - 1] < 256
    n, plain, on = int(upto[-1]), np.flatnonzero(~goes_on), np.flatnonzero(goes_on)
    tokens, exits = bpe.run(symbols, starts[plain], sizes[plain])
    count, leave = np.bincount(owner[plain], tokens, n).astype(np.int64), np.zeros(n, np.int64)
    leave[owner[plain][open_end[plain]]] = exits[open_end[plain]]
    if foreign:
        at = np.searchsorted(edge, [a for a, _ in foreign], side="right") - 1
        count += np.bincount(at, [len(bpe.library.ids(w)) for _, w in foreign], n).astype(np.int64)
    # the run of each chunk that goes on with a word, if one does
    first = np.full(n, -1, np.int64)
    first[owner[on]] = on

    def rows_of(chunk: np.ndarray, entry: np.ndarray) -> Maps:
        own = first[chunk]
        more, left = bpe.run(symbols, starts[own], sizes[own], entry)
        return Maps(chunk, entry, np.where(open_end[own], left, leave[chunk]), count[chunk] + more)

    others = np.flatnonzero(first < 0)
    found = [Maps(others, np.full(len(others), ANY, np.int64), leave[others], count[others])]
    chunk, entry = _entries(symbols, np.flatnonzero(there & word), starts[on], owner[on], bpe)
    while len(chunk):
        found.append(rows_of(chunk, entry))
        whole = Maps(*(np.concatenate([getattr(m, f) for m in found]) for f in ("chunk", "entry", "exit", "count")))
        following = whole.chunk + 1
        asked = (following < n) & (first[np.minimum(following, n - 1)] >= 0)
        missing = np.setdiff1d(following[asked] << 32 | whole.exit[asked], whole.chunk << 32 | whole.entry)
        chunk, entry = missing >> 32, missing & (1 << 32) - 1
    whole = Maps(*(np.concatenate([getattr(m, f) for m in found]) for f in ("chunk", "entry", "exit", "count")))
    order = np.lexsort((whole.entry, whole.chunk))
    return Maps(whole.chunk[order], whole.entry[order], whole.exit[order], whole.count[order]), upto


def _entries(symbols: np.ndarray, words: np.ndarray, cuts: np.ndarray, chunk: np.ndarray, bpe: BpeMachine) -> tuple[np.ndarray, np.ndarray]:
    """(chunk, state) for the states in which chunks cut within words may be entered, by the symbols before each cut only; ``words``: where words begin."""
    begun = words[np.searchsorted(words, cuts, side="right") - 1] if len(cuts) else cuts
    back = np.where(cuts - begun <= LOOK, 1, PLACES)
    at = np.repeat(np.arange(len(cuts)), back)
    shift = np.arange(len(at)) - np.repeat(np.cumsum(back) - back, back)
    begin = np.where(back[at] == 1, begun[at], cuts[at] - LOOK + shift)
    states = bpe.run(symbols, begin, cuts[at] - begin)[1]
    keys = np.unique(chunk[at] << 32 | states)
    return keys >> 32, keys & (1 << 32) - 1


def compose(first: Maps, second: Maps, left: np.ndarray, right: np.ndarray) -> Maps:
    """For each k the map of chunk ``left[k]`` of ``first``, then chunk ``right[k]`` of ``second``, as the map of ``right[k]``."""
    lo, hi = np.searchsorted(first.chunk, left), np.searchsorted(first.chunk, left, side="right")
    rows = np.repeat(lo, hi - lo) + np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
    owner = np.repeat(right, hi - lo)
    then = second.rows(owner, first.exit[rows])
    return Maps(owner, first.entry[rows], second.exit[then], first.count[rows] + second.count[then])


def prefix_scan(maps: Maps, upto: np.ndarray) -> Maps:
    """The maps of all prefixes of each part, in rounds that double their reach."""
    n, step = int(upto[-1]), 1
    first = np.repeat(upto[:-1], np.diff(upto))
    while step < np.diff(upto).max(initial=0):
        right = np.flatnonzero(np.arange(n) - step >= first)
        joined = compose(maps, maps, right - step, right)
        keep = ~np.isin(maps.chunk, right)
        both = [np.concatenate([a[keep], b]) for a, b in ((maps.chunk, joined.chunk), (maps.entry, joined.entry), (maps.exit, joined.exit), (maps.count, joined.count))]
        order = np.lexsort((both[1], both[0]))
        maps, step = Maps(*(x[order] for x in both)), 2 * step
    return maps


def count_texts(texts: list[bytes], bpe: BpeMachine, size: int = CHUNK_BYTES) -> np.ndarray:
    found = np.zeros(len(texts), np.int64)
    for run in pieces(texts):
        maps, upto = chunk_maps([part for _, part in run], bpe, size)
        whole = prefix_scan(maps, upto)
        last = whole.rows(upto[1:] - 1, np.zeros(len(run), np.int64))
        np.add.at(found, [k for k, _ in run], whole.count[last])
        bpe.let_go()
    return found


def token_counts(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of ``df``."""

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = machine(tokenizer)
        for batch in rows:
            texts = batch.column(1).to_pylist()
            counts = count_texts(texts, bpe, chunk_bytes)
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(counts)], names=["doc_id", "n_bytes", "n_tokens"])

    slim = df.select(df[id_col].cast("long").alias("doc_id"), text_bytes(df, text_col).alias("text"))
    found = slim.mapInArrow(each, "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
