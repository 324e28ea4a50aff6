"""Cross-tokenizer alignment: how often tokens of two tokenizers cover the same bytes.

Both tokenizers' tokens cut a text's bytes; where both cut, a group ends.  Between two cuts
that follow each other, of either, exactly one token of each lies, so the links of a text are
its cuts.  A first pass aligns all texts and counts the id pairs of links, task by task.  The
distinct pairs get a minimal perfect hash: dealt into shards by their own bits, each shard is
placed level by level, a pair in the first level in which no other of its shard falls on its
bit, and its hash is the rank of that bit.  The tasks' counts are turned into dense vectors
indexed by the hash, which are summed as a tree.  A second pass aligns the texts again and
looks the counts up; a pair's key is stored at its hash and compared, so a pair that the hash
doesn't know can't take another's count.

The tokens are kept as written between the passes, so each text is encoded once.  The table
that the second pass looks up is broadcast in groups of shards of TABLE_BYTES at most; with
more of them the texts are aligned once for each group.

The byte-level tokenizer is run by a faster library from the merges in its own file, where
the file says that this gives the same ids (tests hold them against its own library); texts
with very long runs without white space go through its own library, whose time doesn't grow
with the square of a run.

Defined results: texts that are null, empty, not valid UTF-8, or not given back in bytes by
the tokens of either tokenizer have no tokens, zeros and an empty digest; rows that share an
id or a text each count; a null id stays null; texts of any length are aligned whole; other
columns, whatever their names, are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallylog.llm.common import CACHES, batches, discard, let_go, materialise, text_bytes

#: pairs of a shard, about; bits of a level for each pair to be placed
SHARD_PAIRS, ROOM = 1 << 16, 2
#: bits by which pairs are dealt to shards
SPOT_BITS = 20
#: rows of partial counts that one task turns into a vector, vectors summed by one task
BRANCH_ROWS, FAN = 1 << 21, 8
#: bytes of the table that is broadcast at once
TABLE_BYTES = 64 << 20
#: pairs that a task holds before it passes them on
HELD_PAIRS = 1 << 21
#: bytes without white space from which on a text goes through the tokenizer's own library
LONG_RUN = 2000
#: fixed value: how byte-level tokenizers of this family split texts
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_MIX = np.uint64(0xD6E8FEB86659FD93)
_RUN = re.compile(rf"\S{{{LONG_RUN}}}")
TOKENS = "doc_id long, a binary, b binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


# --- tokenizers -----------------------------------------------------------------------------


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """Ids and bytes of a byte-level BPE tokenizer from its JSON file; special strings are plain text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        byte_of, special = _byte_of(), {t["content"] for t in made["added_tokens"]}
        vocab = made["model"]["vocab"]
        ranks = {bytes(byte_of[c] for c in token): k for token, k in vocab.items() if token not in special}
        self.pieces = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in made["added_tokens"])]))
        for piece, k in ranks.items():
            self.pieces[k] = piece
        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        merges = [m.split(" ") if isinstance(m, str) else m for m in made["model"]["merges"]]
        order = [vocab["".join(m)] for m in merges]
        model, split = made["model"], made["pre_tokenizer"]
        # ranks stand for merges if ids follow the order of merges
        plain = model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        same = plain and order == sorted(order) and made["normalizer"] is None and split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        self.fast = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}) if same else None

    def ids(self, text: str) -> list[int]:
        if self.fast is None or _RUN.search(text):
            return self.own.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class Pieces:
    """Ids and bytes of a sentencepiece model, which puts a space before a text itself."""

    def __init__(self, path: str):
        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        names = (self.own.id_to_piece(k) for k in range(self.own.vocab_size()))
        self.pieces = [bytes([int(p[3:5], 16)]) if self.own.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(names)]

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.own.encode(texts, num_threads=1)


@lru_cache(2)
def tokenizers_of(path_a: str, path_b: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(path_a), Pieces(path_b)


CACHES.append(tokenizers_of.cache_clear)


# --- alignment ------------------------------------------------------------------------------


class Aligned:
    """The tokens of some texts side by side; ``cut_a`` and ``cut_b`` have the number of tokens before each text, and of all."""

    def __init__(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray):
        self.a, self.b, self.cut_a, self.cut_b = a, b, cut_a, cut_b
        ends_a, ends_b = np.cumsum(sizes_a[a]), np.cumsum(sizes_b[b])
        before = np.searchsorted(ends_b, ends_a)
        self.last_a = ends_b[np.minimum(before, max(0, len(ends_b) - 1))] == ends_a if len(b) else np.zeros(len(a), bool)
        self.last_b = np.zeros(len(b), bool)
        self.last_b[before[self.last_a]] = True
        # cuts of both in order; a shared one is one
        shared = np.cumsum(self.last_a) - self.last_a
        own = np.arange(len(a)) + before - shared
        self.cuts = len(a) + len(b) - int(self.last_a.sum())
        is_a = np.zeros(self.cuts, bool)
        is_a[own] = True
        is_b = ~is_a
        is_b[own[self.last_a]] = True
        self.link_a, self.link_b = np.cumsum(is_a) - is_a, np.cumsum(is_b) - is_b
        groups_a = np.append(0, np.cumsum(self.last_a))
        self.groups = np.diff(groups_a[cut_a])
        self.cut_links = cut_a + cut_b - groups_a[cut_a]

    def keys(self, n_b: int) -> np.ndarray:
        """The id pair of every link, as one number."""
        return self.a[self.link_a].astype(np.int64) * n_b + self.b[self.link_b]

    def group_texts(self, names: list[bytes], n_a: int) -> Iterator[bytes]:
        """Each text's groups, written out; ``names``: ids with what follows them (A then ',', A then '|', B then ',', B then ';')."""
        # a token of A has before it the tokens of B of earlier groups, one of B those of A up to its own group
        group_a, group_b = np.cumsum(self.last_a) - self.last_a, np.cumsum(self.last_b) - self.last_b
        ends_a, ends_b = np.append(0, np.flatnonzero(self.last_a) + 1), np.append(0, np.flatnonzero(self.last_b) + 1)
        out = np.empty(len(self.a) + len(self.b), np.int64)
        n_b = (len(names) - 2 * n_a) // 2
        out[np.arange(len(self.a)) + ends_b[group_a]] = self.a + n_a * self.last_a
        out[np.arange(len(self.b)) + ends_a[group_b + 1]] = self.b + 2 * n_a + n_b * self.last_b
        cut = (self.cut_a + self.cut_b).tolist()
        for first, last in zip(cut[:-1], cut[1:], strict=True):
            yield b"".join([names[k] for k in out[first:last].tolist()])[:-1]


def _kind(of_ids: list[bytes] | np.ndarray) -> np.dtype:
    return np.dtype("<u2") if len(of_ids) <= 1 << 16 else np.dtype("<i4")


def sizes_of(pieces: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, pieces), np.int64, len(pieces))


def aligned_rows(batch: pa.RecordBatch, sizes_a: np.ndarray, sizes_b: np.ndarray) -> Aligned:
    """The stored tokens of a batch of rows with columns ``a`` and ``b``; how many bytes each id stands for."""

    def column(name: str, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
        held = batch.column(batch.schema.get_field_index(name)).to_pylist()
        return np.frombuffer(b"".join(held), kind).astype(np.int64), np.append(0, np.cumsum([len(x) // kind.itemsize for x in held])).astype(np.int64)

    (a, cut_a), (b, cut_b) = column("a", _kind(sizes_a)), column("b", _kind(sizes_b))
    return Aligned(a, b, cut_a, cut_b, sizes_a, sizes_b)


def _slices(batch: pa.RecordBatch, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``limit`` bytes of tokens."""
    held = batch.column(batch.schema.get_field_index("a")).to_pylist()
    for s in batches(held, limit):
        yield batch.slice(s.start, s.stop - s.start)


def encoded(df: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """The tokens of each row of ``df`` in both tokenizers, and what its alignment alone tells: TOKENS."""

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = tokenizers_of(path_a, path_b)
        sizes_a, sizes_b = sizes_of(one.pieces), sizes_of(two.pieces)
        names = [b"%d%b" % (k, end) for x, ends in ((one, (b",", b"|")), (two, (b",", b";"))) for end in ends for k in range(len(x.pieces))]
        for batch in rows:
            data = batch.column(1).to_pylist()
            for s in batches(data):
                part = data[s]
                texts = [x.decode("utf-8", "replace") for x in part]
                ids_b, ids_a = two.ids(texts), []
                for k, (raw, text) in enumerate(zip(part, texts, strict=True)):
                    own = one.ids(" " + text) if raw else []
                    if not raw or b"".join([one.pieces[i] for i in own]) != b" " + raw or b"".join([two.pieces[i] for i in ids_b[k]]) != b" " + raw:
                        own, ids_b[k] = [], []
                    ids_a.append(own)
                n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (ids_a, ids_b))
                ids_a, ids_b = ([np.array(own, _kind(t.pieces)) for own in x] for t, x in ((one, ids_a), (two, ids_b)))
                a, b = (np.concatenate(x).astype(np.int64) for x in (ids_a, ids_b))
                both = Aligned(a, b, np.append(0, np.cumsum(n_a)), np.append(0, np.cumsum(n_b)), sizes_a, sizes_b)
                told = [hashlib.sha256(x).hexdigest() if n else "" for x, n in zip(both.group_texts(names, len(one.pieces)), n_a.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s.start, len(part)), *(pa.array([x.tobytes() for x in own], pa.binary()) for own in (ids_a, ids_b)), pa.array(n_a), pa.array(n_b), pa.array(both.groups), pa.array(np.diff(both.cut_links)), pa.array(told, pa.string())],
                    names=[x.split()[0] for x in TOKENS.split(", ")],
                )

    slim = df.select(df[id_col].cast("long").alias("doc_id"), text_bytes(df, text_col).alias("text"))
    return slim.mapInArrow(each, TOKENS)


# --- counts by hash -------------------------------------------------------------------------


def _mixed(keys: np.ndarray, turn: int) -> np.ndarray:
    found = (keys.view(np.uint64) ^ np.uint64((turn * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))) * _MIX
    found ^= found >> np.uint64(32)
    found *= _MIX
    return found ^ (found >> np.uint64(29))


def spots(keys: np.ndarray) -> np.ndarray:
    """The bits that deal pairs to shards."""
    return (_mixed(keys, 0) >> np.uint64(64 - SPOT_BITS)).astype(np.int64)


def partial_counts(tokens: DataFrame, sizes: object) -> DataFrame:
    """(pair, spot, n): links of each id pair, summed within tasks."""

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        sizes_a, sizes_b = sizes.value
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            n = np.zeros(len(keys), np.int64)
            np.add.at(n, at, np.concatenate([n for _, n in held]))
            return keys, n

        def emit(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(keys), 1 << 16):
                s = slice(k, k + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(keys[s]), pa.array(spots(keys[s])), pa.array(n[s])], names=["pair", "spot", "n"])

        for batch in rows:
            for part in _slices(batch):
                held.append(np.unique(aligned_rows(part, sizes_a, sizes_b).keys(len(sizes_b)), return_counts=True))
            if sum(len(k) for k, _ in held) > HELD_PAIRS:
                keys, n = summed()
                held = [(keys, n)]
                if len(keys) > HELD_PAIRS // 2:
                    yield from emit(keys, n)
                    held = []
        if held:
            yield from emit(*summed())

    return tokens.where("n_a > 0").select("a", "b").mapInArrow(each, "pair long, spot long, n long")


def placed(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(bits of each level, the bits, the keys in the order of their hashes) of a minimal perfect hash of distinct keys."""
    sizes, bits, order, turn = [], [], [], 1
    while len(keys):
        size = max(64, ROOM * len(keys) // 64 * 64)
        at = (_mixed(keys, turn) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        own = np.flatnonzero(alone[at])
        order.append(keys[own[np.argsort(at[own])]])
        sizes.append(size)
        bits.append(alone)
        keys, turn = keys[~alone[at]], turn + 1
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool), np.concatenate(order) if order else keys


class PairTable:
    """The hashes of several shards, with a key and a count at each; ``of`` looks pairs up."""

    def __init__(self, shards: int, rows: list[dict]):
        levels = max((len(r["sizes"]) for r in rows), default=0)
        self.shards = shards
        self.size, self.first = np.zeros((shards, levels), np.uint64), np.zeros((shards, levels), np.int64)
        at = 0
        for r in rows:
            for level, size in enumerate(r["sizes"]):
                self.size[r["shard"], level], self.first[r["shard"], level] = size, at
                at += size
        joined = lambda name, kind: np.frombuffer(b"".join(r[name] for r in rows), kind)
        self.words, self.keys, self.counts = joined("bits", np.uint64), joined("keys", np.int64), joined("counts", np.int64)
        self.rank = np.append(0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64))

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The count of each pair, 0 where the table doesn't have it."""
        found = np.zeros(len(keys), np.int64)
        left, shard = np.arange(len(keys)), spots(keys) % self.shards
        for level in range(self.size.shape[1]):
            size = self.size[shard, level]
            known = size > 0
            left, shard, size = left[known], shard[known], size[known]
            at = self.first[shard, level] + (_mixed(keys[left], level + 1) % size).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) > 0
            slot = self.rank[at[hit] >> 6] + np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            own = left[hit]
            found[own] = np.where(self.keys[slot] == keys[own], self.counts[slot], 0)
            left, shard = left[~hit], shard[~hit]
        return found


def hashed_counts(partial: DataFrame) -> tuple[DataFrame, int]:
    """(shard, sizes, bits, keys, counts) of the distinct pairs of ``partial``, and the number of shards."""
    distinct = materialise(partial.select("pair", "spot").distinct(), "pairs")
    shards = min(1 << SPOT_BITS, max(1, -(-distinct.count() // SHARD_PAIRS)))
    branches = max(2, -(-partial.count() // (shards * BRANCH_ROWS)))

    def place(table: pa.Table) -> pa.Table:
        sizes, bits, order = placed(np.sort(table.column("pair").to_numpy()))
        return pa.table({"shard": table.column("shard").slice(0, 1), "sizes": pa.array([sizes], pa.list_(pa.int64())), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()), "keys": pa.array([order.tobytes()], pa.binary())})

    hashes = distinct.withColumn("shard", F.col("spot") % shards).groupBy("shard").applyInArrow(place, "shard long, sizes array<long>, bits binary, keys binary")
    hashes = materialise(hashes, "hashes")

    def vector(left: pa.Table, right: pa.Table) -> pa.Table:
        row = right.to_pylist()[0]
        size = len(row["keys"]) // 8
        # the table of one shard with each pair's hash where its count will be
        slots = PairTable(1, [row | {"shard": 0, "counts": np.arange(1, size + 1).tobytes()}]).of(left.column("pair").to_numpy()) - 1
        found = np.zeros(size, np.int64)
        np.add.at(found, slots, left.column("n").to_numpy())
        return pa.table({"shard": right.column("shard").slice(0, 1), "branch": right.column("branch").slice(0, 1), "counts": pa.array([found.tobytes()], pa.binary())})

    def total(table: pa.Table) -> pa.Table:
        found = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("counts"))
        return pa.table({"shard": table.column("shard").slice(0, 1), "branch": table.column("branch").slice(0, 1), "counts": pa.array([found.tobytes()], pa.binary())})

    dealt = partial.select("pair", "n", (F.col("spot") % shards).alias("shard"), F.pmod(F.xxhash64("pair", "n", F.spark_partition_id()), F.lit(branches)).alias("branch"))
    each_branch = hashes.withColumn("branch", F.explode(F.sequence(F.lit(0), F.lit(branches - 1)))).withColumn("branch", F.col("branch").cast("long"))
    # a branch without counts of a shard has no vector
    used = dealt.select("shard", "branch").distinct()
    sums = dealt.groupBy("shard", "branch").cogroup(each_branch.join(used, ["shard", "branch"], "left_semi").groupBy("shard", "branch")).applyInArrow(vector, "shard long, branch long, counts binary")
    while branches > 1:
        branches = -(-branches // FAN)
        sums = sums.withColumn("branch", F.floor(F.col("branch") / FAN)).groupBy("shard", "branch").applyInArrow(total, "shard long, branch long, counts binary")
    table = materialise(hashes.join(sums.select("shard", "counts"), "shard"), "counts")
    discard(distinct, hashes)
    return table, shards


def most_of(table: DataFrame, n_b: int) -> np.ndarray:
    """The greatest count of each B id; as many numbers as the tokenizer has ids."""

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.zeros(n_b, np.int64)
        for batch in rows:
            for keys, counts in zip(batch.column(0), batch.column(1), strict=True):
                np.maximum.at(most, np.frombuffer(keys.as_py(), np.int64) % n_b, np.frombuffer(counts.as_py(), np.int64))
        own = np.flatnonzero(most)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(most[own])], names=["b", "n"])

    found = np.zeros(n_b, np.int64)
    for row in table.select("keys", "counts").mapInArrow(each, "b long, n long").groupBy("b").agg(F.max("n").alias("n")).collect():
        found[row["b"]] = row["n"]
    return found


def looked_up(tokens: DataFrame, held: object, most: object, sizes: object, done: bool) -> DataFrame:
    """``tokens`` with what one part of the table adds to ``n_best`` and ``count_sum``; ``done``: without the tokens."""
    names = [c for c in tokens.columns if not (done and c in ("a", "b"))]
    kinds = {f.name: f.dataType.simpleString() for f in tokens.schema}

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        sizes_a, sizes_b = sizes.value
        n_b, table, greatest = len(sizes_b), PairTable(*held.value), most.value
        for batch in rows:
            for part in _slices(batch):
                both = aligned_rows(part, sizes_a, sizes_b)
                keys = both.keys(n_b)
                # most links are of few pairs
                own, at = np.unique(keys, return_inverse=True)
                counts = table.of(own)
                best = (counts == greatest[own % n_b]) & (counts > 0)
                sums = [np.diff(np.append(0, np.cumsum(x[at]))[both.cut_links]) for x in (best.astype(np.int64), counts)]
                columns = dict(zip(part.schema.names, part.columns, strict=True))
                for name, more in zip(("n_best", "count_sum"), sums, strict=True):
                    columns[name] = pa.array(columns[name].to_numpy() + more)
                yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return tokens.mapInArrow(each, ", ".join(f"{c} {kinds[c]}" for c in names))


def table_groups(table: DataFrame, shards: int) -> Iterator[tuple[int, list[dict]]]:
    """Runs of shards of about TABLE_BYTES each, one at a time on the driver."""
    sizes = {r["shard"]: r["size"] for r in table.select("shard", (F.octet_length("bits") + F.octet_length("keys") + F.octet_length("counts")).alias("size")).collect()}
    run, used = [], 0
    for shard in sorted(sizes):
        if run and used + sizes[shard] > TABLE_BYTES:
            yield shards, [r.asDict() for r in table.where(F.col("shard").isin(run)).collect()]
            run, used = [], 0
        run.append(shard)
        used += sizes[shard]
    if run:
        yield shards, [r.asDict() for r in table.where(F.col("shard").isin(run)).collect()]


def alignments(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of ``df``."""
    spark = df.sparkSession
    one, two = tokenizers_of(path_a, path_b)
    sizes, n_b = spark.sparkContext.broadcast((sizes_of(one.pieces), sizes_of(two.pieces))), len(two.pieces)
    tokenizers_of.cache_clear()
    tokens = materialise(encoded(df, path_a, path_b, id_col, text_col), "tokens")
    partial = materialise(partial_counts(tokens, sizes), "partial")
    table, shards = hashed_counts(partial)
    discard(partial)
    most = spark.sparkContext.broadcast(most_of(table, n_b))
    found = tokens.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    waiting: tuple[int, list[dict]] | None = None
    for group in table_groups(table, shards):
        if waiting is not None:
            after = materialise(looked_up(found, spark.sparkContext.broadcast(waiting), most, sizes, False), "tokens")
            discard(found, tokens)
            found = after
        waiting = group
    if waiting is not None:
        found = looked_up(found, spark.sparkContext.broadcast(waiting), most, sizes, True)
    discard(table)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
