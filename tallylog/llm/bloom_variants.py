"""Spelling variants by Bloom-guided neighbourhoods.

Words are counted over all texts; those of LEAST_CHARS code points and LEAST_ROWS occurrences
are the vocabulary.  Two words are near if one edit (a code point inserted, deleted or
replaced) leads from one to the other.  The edits of every word are generated as rolling
hashes and probed against Bloom filters of the vocabulary, sharded by word length and blocked
in 64-bit units, so that a probe reads one unit.  Only the positives, spelled out, shuffle to a
join with the vocabulary, which removes the false ones.  An insertion into one word is a
deletion from the other, and a replacement by a greater code point is one by a smaller in the
other word, so deletions and replacements by greater code points find every pair once.

A filter's size is known before it is made.  Filters are broadcast in groups of FILTER_BYTES at
most, a length with more words in several parts by hash; each group probes the edits of the
lengths that it covers, so the work, but not the memory, grows with the vocabulary.

Defined results: a null or empty text has no words; a null id counts as an empty one in the
rule that damages runs; rows with equal ids and texts count as often as they are there; a tie
for a word's form goes to the first word by code points; words of any length are taken whole;
columns other than the id and the text, whatever their names, are not looked at; an empty
table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylog.llm.common import discard, let_go, materialise, text_bytes

LEAST_CHARS, LEAST_ROWS = 5, 3
#: a run whose checksum this divides loses a code point
DAMAGE = 97
#: words from this length on share a filter
LONGEST = 64
#: bits of a filter for each word, bytes of the filters that are broadcast together, and those of a part that is summed by itself
WORD_BITS, FILTER_BYTES, CHUNK_UNITS = 32, 32 << 20, 4096
#: words that a task counts before it passes them on, and edits that are probed together
COUNTED, PROBED = 1 << 18, 1 << 20
_UPPER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: characters of several bytes but for U+00C0 to U+00FF, and bytes that aren't valid
_FOREIGN = re.compile(rb"[\xc0-\xc2\xc4-\xff][\x80-\xbf]*|(?<!\xc3)[\x80-\xbf]|\xc3(?![\x80-\xbf])")
_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)


def runs_of(text: bytes) -> list[bytes]:
    """The maximal runs of letters a-z and U+00C0 to U+00FF, A-Z in lower case."""
    data = text.translate(_UPPER)
    if not data.isascii():
        data = _FOREIGN.sub(b" ", data)
    return data.translate(_LETTERS).split()


def damaged(run: bytes, crc: int) -> bytes:
    """``run`` without the code point that its checksum names."""
    text = run.decode()
    at = crc % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def count_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): partial counts of the words of LEAST_CHARS code points or more, each task's summed before they are shuffled."""

    def emit(counts: dict[bytes, int]) -> pa.RecordBatch:
        kept = [(w, n) for w, n in counts.items() if len(w) - w.count(b"\xc3") >= LEAST_CHARS]
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        counts: dict[bytes, int] = defaultdict(int)
        for batch in rows:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                crc32, start = zlib.crc32, zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in Counter(runs_of(text.as_py())).items():
                    crc = crc32(run, start)
                    counts[run if crc % DAMAGE else damaged(run, crc)] += n
                if len(counts) > COUNTED:
                    yield emit(counts)
                    counts.clear()
        if counts:
            yield emit(counts)

    slim = df.select(df[id_col].cast("string").alias("doc_id"), text_bytes(df, text_col).alias("text"))
    return slim.mapInArrow(each, "word string, n long")


def vocabulary(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words with LEAST_ROWS occurrences or more."""
    return count_words(df, id_col, text_col).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_ROWS)


# --- filters --------------------------------------------------------------------------------


def _scattered(codes: np.ndarray) -> np.ndarray:
    codes = (codes ^ (codes >> np.uint64(32))) * _MIX
    return codes ^ (codes >> np.uint64(29))


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.append(np.uint64(1), np.full(n, _BASE, np.uint64)))


def letters(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)


def codes_of(points: np.ndarray) -> np.ndarray:
    """Rolling hashes of words of one length, before they are scattered."""
    return (points * _powers(points.shape[1])[:-1]).sum(1, dtype=np.uint64)


class Plan:
    """Where each length's filter is: (length, part) to (first unit, units); known from the number of words of each length."""

    def __init__(self, sizes: dict[int, int]):
        most = FILTER_BYTES // 8
        self.parts = {length: max(1, -(-(n * WORD_BITS // 64 + 1) // most)) for length, n in sizes.items()}
        units = {(length, part): n * WORD_BITS // 64 // self.parts[length] + 1 for length, n in sizes.items() for part in range(self.parts[length])}
        self.groups: list[dict[tuple[int, int], tuple[int, int]]] = []
        used = most
        for key, size in sorted(units.items()):
            if used + size > most:
                self.groups.append({})
                used = 0
            self.groups[-1][key] = (used, size)
            used += size


def _places(codes: np.ndarray, first: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The unit and the bits in it of each scattered hash."""
    unit = first + ((codes >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
    return unit, codes


def _bits(codes: np.ndarray) -> np.ndarray:
    one, low = np.uint64(1), np.uint64(63)
    found = one << (codes & low)
    for k in (6, 12, 18, 24):
        found |= one << ((codes >> np.uint64(k)) & low)
    return found


def _part_of(codes: np.ndarray, parts: int) -> np.ndarray:
    """Which part of a length's filter a scattered hash belongs to, by a hash of its own."""
    return (_scattered(codes + np.uint64(1)) % np.uint64(parts)).astype(np.int64)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """(length, words, counts) of the words of each length."""
    words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
    groups: dict[int, list[int]] = defaultdict(list)
    for k, w in enumerate(words):
        groups[len(w)].append(k)
    for length, at in groups.items():
        yield length, [words[k] for k in at], n[at]


def filters(words: DataFrame, plan: Plan, group: dict[tuple[int, int], tuple[int, int]]) -> np.ndarray:
    """The filters of a group, FILTER_BYTES at most: each task sets its words' bits, and the parts of what they set are or-ed."""
    units = sum(size for _, size in group.values())

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        held = np.zeros(-(-units // CHUNK_UNITS) * CHUNK_UNITS, np.uint64)
        for batch in rows:
            for length, own, _ in _by_length(batch):
                shard = min(length, LONGEST)
                codes = _scattered(codes_of(letters(own)))
                part = _part_of(codes, plan.parts[shard])
                for (_, p), (first, size) in ((k, v) for k, v in group.items() if k[0] == shard):
                    unit, mine = _places(codes[part == p], first, size)
                    np.bitwise_or.at(held, unit, _bits(mine))
        chunks = held.reshape(-1, CHUNK_UNITS)
        used = np.flatnonzero(chunks.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([chunks[k].tobytes() for k in used], pa.binary())], names=["chunk", "bits"])

    def merged(table: pa.Table) -> pa.Table:
        found = np.zeros(CHUNK_UNITS, np.uint64)
        for bits in table.column("bits"):
            found |= np.frombuffer(bits.as_py(), np.uint64)
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "bits": pa.array([found.tobytes()], pa.binary())})

    own = words.where(F.least(F.length("word"), F.lit(LONGEST)).isin(sorted({k[0] for k in group})))
    # tasks that fill a filter each are few; a branch is a bounded number of them
    branches = own.coalesce(64).mapInArrow(each, "chunk long, bits binary")
    made = branches.groupBy("chunk").applyInArrow(merged, "chunk long, bits binary")
    found = np.zeros(-(-units // CHUNK_UNITS) * CHUNK_UNITS, np.uint64)
    for row in made.toLocalIterator():
        found[row["chunk"] * CHUNK_UNITS :][:CHUNK_UNITS] = np.frombuffer(row["bits"], np.uint64)
    return found


def _probes(points: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[str, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, length, word, place, code point, hash) of edits, at most about PROBED at a time."""
    rows, size = points.shape
    power = _powers(size)
    terms = points * power[:-1]
    before = np.zeros((rows, size + 1), np.uint64)
    np.cumsum(terms, 1, dtype=np.uint64, out=before[:, 1:])
    whole = before[:, -1:]
    for first in range(0, size, max(1, PROBED // max(1, rows))):
        at = slice(first, min(size, first + max(1, PROBED // max(1, rows))))
        code = before[:, at] + (whole - before[:, at.start + 1 : at.stop + 1]) * _INVERSE
        # of a run of equal code points one is deleted
        fresh = np.ones(code.shape, bool)
        fresh[:, (1 if first == 0 else 0) :] = points[:, max(1, first) : at.stop] != points[:, max(0, first - 1) : at.stop - 1]
        word, place = np.nonzero(fresh)
        yield "delete", size - 1, word, place + first, np.zeros(len(word), np.uint64), code[fresh]
    step = max(1, PROBED // max(1, rows * len(alphabet)))
    for first in range(0, size, step):
        own = points[:, first : first + step, None]
        shift = (alphabet[None, None, :] - own) * power[first : first + own.shape[1]][None, :, None]
        later = alphabet[None, None, :] > own
        word, place, letter = np.nonzero(later)
        yield "replace", size, word, place + first, alphabet[letter], (whole[:, :, None] + shift)[later]


def positives(words: DataFrame, plan: Plan, group: dict[tuple[int, int], tuple[int, int]], held: object, alphabet: np.ndarray) -> DataFrame:
    """(word, n, edit): the edits of ``words`` that a group's filters let pass."""
    shards = {k[0] for k in group}

    def found(own: list[str], n: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        for kind, length, word, place, letter, code in _probes(letters(own), alphabet):
            shard = min(length, LONGEST)
            if shard not in shards:
                continue
            code = _scattered(code)
            part = _part_of(code, plan.parts[shard]) if plan.parts[shard] > 1 else None
            for (_, p), (first, size) in ((k, v) for k, v in group.items() if k[0] == shard):
                at = np.arange(len(code)) if part is None else np.flatnonzero(part == p)
                unit, mine = _places(code[at], first, size)
                seen = bits[unit]
                # most edits fail at their first bit
                left = np.flatnonzero((seen >> (mine & np.uint64(63))) & np.uint64(1))
                want = _bits(mine[left])
                hit = at[left[(seen[left] & want) == want]]
                edits = []
                for w, k, c in zip(word[hit].tolist(), place[hit].tolist(), letter[hit].tolist(), strict=True):
                    edits.append(own[w][:k] + (chr(c) if kind == "replace" else "") + own[w][k + 1 :])
                if edits:
                    yield pa.RecordBatch.from_arrays([pa.array([own[w] for w in word[hit]], pa.string()), pa.array(n[word[hit]]), pa.array(edits, pa.string())], names=["word", "n", "edit"])

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        bits = np.frombuffer(held.value, np.uint64)
        for batch in rows:
            for _, own, n in _by_length(batch):
                step = max(1, PROBED // (len(own[0]) * len(alphabet)))
                for first in range(0, len(own), step):
                    yield from found(own[first : first + step], n[first : first + step], bits)

    # a filter of a length is probed by words of it and by those of one code point more
    size = F.length("word")
    near = F.least(size, F.lit(LONGEST)).isin(sorted(shards)) | F.least(size - 1, F.lit(LONGEST)).isin(sorted(shards))
    return words.where(near).mapInArrow(each, "word string, n long, edit string")


# --- forms ----------------------------------------------------------------------------------


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): the pairs of near words of ``words`` (word, n), each once."""
    spark = words.sparkSession
    # at most LONGEST rows, and as many letters as there are in the pattern
    sizes = {r["size"]: r["n"] for r in words.groupBy(F.least(F.length("word"), F.lit(LONGEST)).alias("size")).agg(F.count("*").alias("n")).collect()}
    alphabet = np.array(sorted(ord(r[0]) for r in words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()), np.uint64)
    plan, found = Plan(sizes), []
    exact = words.select(F.col("word").alias("b"), F.col("n").alias("b_n"))
    for group in plan.groups:
        held = spark.sparkContext.broadcast(filters(words, plan, group).tobytes())
        told = positives(words, plan, group, held, alphabet)
        found.append(materialise(told.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("edit").alias("b")).join(exact, "b").select("a", "a_n", "b", "b_n"), "near"))
        held.destroy()
    whole = found[0] if found else spark.createDataFrame([], "a string, a_n long, b string, b_n long")
    for more in found[1:]:
        whole = whole.union(more)
    return whole


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root): where the words of ``forms`` (word, form) end if forms are followed; a form is twice as frequent, so few doublings do."""
    held = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = held.select(F.col("word").alias("_word"), F.col("root").alias("_next"))
        after = materialise(held.join(onward, held["root"] == onward["_word"], "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        discard(held)
        held = after
        if held.where("moved").isEmpty():
            return held.select("word", "root")


def spelling_forms(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each word of the vocabulary of ``df``."""
    words = materialise(vocabulary(df, id_col, text_col), "vocabulary")
    pairs = near_pairs(words)
    both = pairs.union(pairs.select("b", "b_n", "a", "a_n")).toDF("word", "n", "other", "other_n")
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    told = words.join(near, "word", "left").withColumn("often", -F.col("best.less") >= 2 * F.col("n"))
    told = materialise(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("often"), F.col("best.other")).alias("form"), F.when(F.col("often"), -F.col("best.less")).alias("form_n")), "forms")
    ends = roots_of(told.where("form is not null").select("word", "form"))
    return told.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
