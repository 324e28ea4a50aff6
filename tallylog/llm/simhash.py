"""SimHash near-duplicate groups by a binary-trie self-join.

Fingerprints of word shingles are sorted into a binary trie.  The self-join walks pairs of
trie nodes together, adds up the bits in which the two paths differ and drops a pair once
they exceed the budget, so two subtrees are compared only as deep as they can still hold a
link.  Work is dealt out by pairs of prefixes; each task keeps a spanning forest of the
links it finds, never the links themselves, and the forests are joined into components by
alternating star contraction.

Work is dealt out by prefixes of rotated fingerprints: of BUDGET + 1 blocks of bits, two
fingerprints within the budget share one whole, so with each block in turn at the front they
meet under a common prefix of it.  A fingerprint goes to BUDGET + 1 tries, however many there
are.

Defined results: a null text is an empty one; a text without words has fingerprint zero and
links like any other; rows that share a document id each get their own fingerprint; a null
id takes part in links but never names a component unless the component has no other id
(then it is null).  Columns other than the id and the text, whatever their names, are not
looked at; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylog.llm.common import discard, fresh_names, materialise, small, text_bytes

BITS = 64
BUDGET = 4
SHINGLE = 4
SEED = 42
#: distinct fingerprints that one prefix should hold, as long as blocks have bits enough for it
NODE_ROWS = 1 << 15
#: files of a table of links at least, and links of a file
FEW_PARTS, EDGES_A_PART = 8, 100_000
#: pairs of nodes, or of leaves, that are looked at together
CHUNK = 1 << 18
#: below this many leaf pairs a node pair is compared leaf by leaf
DIRECT = 32
_ONE = np.uint64(1)


def fingerprint(data: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits of the XXH64 of every word shingle, repeats included."""
    words = data.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    line = b" ".join(words)
    if len(words) <= shingle:
        return digest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: len(words) - shingle] + 1])
    hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, key, fp) for each row of ``df``; ``key`` is the XXH64 of the text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["doc_id", "key", "fp"])

    text = text_bytes(df, text_col)
    slim = df.select(df[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    return slim.mapInArrow(each, "doc_id long, key long, fp long")


class Trie:
    """Sorted distinct fingerprints; a node of level d is a run that shares d leading bits."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self._levels: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def starts(self, level: int) -> np.ndarray:
        """Where the nodes of a level begin; the end of the last one follows."""
        return self._level(level)[0]

    def _level(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if level not in self._levels:
            n = len(self.values)
            if level == 0:
                starts = np.array([0], np.int64)
            else:
                head = self.values >> np.uint64(BITS - level)
                starts = np.concatenate([[0], np.flatnonzero(head[1:] != head[:-1]) + 1]).astype(np.int64)
            self._levels[level] = (np.append(starts, n), None, None)
        return self._levels[level]

    def children(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """For each node its child by bit 0 and by bit 1, -1 where there is none."""
        at = self._level(level)
        if at[1] is None:
            own, below = at[0][:-1], self.starts(level + 1)[:-1]
            first = np.searchsorted(below, own)
            count = np.diff(np.append(first, len(below)))
            bit = (self.values[own] >> np.uint64(BITS - 1 - level)) & _ONE
            zero = np.where(bit == 0, first, -1).astype(np.int32)
            one = np.where(bit == 1, first, np.where(count == 2, first + 1, -1)).astype(np.int32)
            self._levels[level] = at = (at[0], zero, one)
        return at[1], at[2]


class Forest:
    """Components of the links seen so far."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def trie_join(left: np.ndarray, right: np.ndarray | None, level: int, apart: int, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of fingerprints that differ in ``budget`` bits at most.

    ``left`` and ``right`` are sorted and distinct, share ``level`` leading bits each, and
    these prefixes differ in ``apart`` bits; ``right`` None joins ``left`` with itself.
    """
    own = right is None
    one, two = Trie(left), Trie(left if own else right)
    if own:
        two = one
    zero = np.zeros(1, np.int32)
    todo = [(level, zero, zero, np.full(1, apart, np.int8))]
    while todo:
        d, x, y, diff = todo.pop()
        if len(x) > CHUNK:
            half = len(x) // 2
            todo += [(d, x[:half], y[:half], diff[:half]), (d, x[half:], y[half:], diff[half:])]
            continue
        sx, sy = one.starts(d), two.starts(d)
        nx, ny = sx[x + 1] - sx[x], sy[y + 1] - sy[y]
        small = (nx * ny <= DIRECT) | (d == BITS)
        if small.any():
            yield from _leaves(one.values, two.values, sx[x[small]], nx[small], sy[y[small]], ny[small], budget, own)
            x, y, diff = x[~small], y[~small], diff[~small]
        if not len(x):
            continue
        x0, x1 = (c[x] for c in one.children(d))
        y0, y1 = (c[y] for c in two.children(d))
        cross = diff < budget
        # a node with itself: its two children meet once only
        once = cross & ~(own & (x == y)) if own else cross
        below = []
        for a, b, more, ok in ((x0, y0, 0, True), (x1, y1, 0, True), (x0, y1, 1, cross), (x1, y0, 1, once)):
            keep = np.flatnonzero((a >= 0) & (b >= 0) & ok)
            below.append((a[keep], b[keep], diff[keep] + np.int8(more)))
        todo.append((d + 1, *map(np.concatenate, zip(*below, strict=True))))


def _leaves(a: np.ndarray, b: np.ndarray, lo_a: np.ndarray, n_a: np.ndarray, lo_b: np.ndarray, n_b: np.ndarray, budget: int, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among the leaves of small node pairs, a bounded number of pairs at a time."""
    total = np.cumsum(n_a * n_b)
    done = 0
    while done < len(lo_a):
        upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + 4 * CHUNK)))
        part = slice(done, upto)
        size = n_a[part] * n_b[part]
        pair = np.repeat(np.arange(len(size)), size)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
        width = n_b[part][pair]
        i, j = lo_a[part][pair] + k // width, lo_b[part][pair] + k % width
        near = np.bitwise_count(a[i] ^ b[j]) <= budget
        if own:
            near &= i < j
        yield i[near], j[near]
        done = upto


def rotated(values: np.ndarray, bits: int) -> np.ndarray:
    """``values`` with their first ``bits`` bits moved to the end."""
    return values << np.uint64(bits) | values >> np.uint64(BITS - bits) if bits % BITS else values


def forest_of(values: np.ndarray, level: int, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """(u, v): a spanning forest of the links between fingerprints that share ``level`` leading bits."""
    values = np.unique(values)
    forest, seen, waiting = Forest(len(values)), [], 0

    def settle() -> None:
        if seen:
            forest.link(np.concatenate([i for i, _ in seen]), np.concatenate([j for _, j in seen]))
            seen.clear()

    for i, j in trie_join(values, None, level, 0, budget):
        seen.append((i, j))
        waiting += len(i)
        if waiting > CHUNK:
            settle()
            waiting = 0
    settle()
    child = np.flatnonzero(forest.root != np.arange(len(values)))
    return values[child], values[forest.root[child]]


def trie_links(values: DataFrame, count: int, budget: int = BUDGET) -> DataFrame:
    """Spanning forests (u, v) of the links between the distinct fingerprints ``fp``, of which there are ``count``."""
    blocks = budget + 1
    first = [BITS * k // blocks for k in range(blocks)]
    depth = min(BITS // blocks, max(2, math.ceil(math.log2(max(1, count) / NODE_ROWS))))
    turn = lambda k: F.shiftleft("fp", k).bitwiseOR(F.shiftrightunsigned("fp", BITS - k)) if k else F.col("fp")
    dealt = values.select(F.explode(F.array(*[F.struct(F.lit(k).alias("turn"), turn(k).alias("fp")) for k in first])).alias("_t")).select("_t.turn", "_t.fp")

    def join(key: tuple, table: pa.Table) -> pa.Table:
        u, v = forest_of(table.column("fp").to_numpy().view(np.uint64), depth, budget)
        back = BITS - key[0].as_py()
        return pa.table({"u": rotated(u, back).view(np.int64), "v": rotated(v, back).view(np.int64)})

    return dealt.withColumn("head", F.shiftrightunsigned("fp", BITS - depth)).groupBy("turn", "head").applyInArrow(join, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches, by star contraction.

    Each round points the larger neighbours of a node at its smallest neighbour, then the
    smaller ones, until all that is left are stars; only whether it is so reaches the driver.
    """
    edges = materialise(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    # few edges go to few files, whatever the number of shuffle partitions
    parts = max(FEW_PARTS, edges.count() // EDGES_A_PART)
    if parts < int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        fewer_files = lambda df: df.coalesce(parts)
    else:
        fewer_files = lambda df: df
    while True:
        # in a star a node has one edge down, and none that comes from above
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
        loose = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or down = 1 and up = 1")
        if loose.isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(fewer_files(large.where("u <> v")), "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        fewer = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialise(fewer_files(fewer.union(least.select("u", F.col("m").alias("v"))).distinct()), "links")
        discard(edges, large)
        edges = after


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, budget: int = BUDGET, keyed: bool = False) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``df``; ``keyed``: (doc_id, key, root), ``key`` being the XXH64 of the text."""
    docs = materialise(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    classes = materialise(docs.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = components(trie_links(classes.select("fp"), classes.count(), budget))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "classes")
    if keyed:
        return docs.join(rooted, "fp").select("doc_id", "key", "root")
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    names = materialise(rooted.join(named, "root").select("fp", "component_id"), "classes")
    discard(classes, rooted)
    return docs.join(names, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """Rows of ``df`` that stay when one row of each near-duplicate group does, as ``first_of`` says."""
    groups = simhash_groups(df, id_col, text_col, keyed=True, **options)
    return first_of(df, groups, id_col, text_col)


def first_of(df: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text", text_key: F.Column | None = None) -> DataFrame:
    """Rows of ``df`` that stay when one row of each of the ``groups`` (doc_id, key, root) does.

    ``key`` is the XXH64 of the text, or ``text_key`` if that is given.  The row with the smallest id stays, of equal ids the
    one with the smallest key.  Rows that share both are one; of these the one with the
    smallest hash of all columns stays.  Rows without an id stay, as nothing names them.
    """
    held = materialise(groups.where("doc_id is not null").groupBy("root", "doc_id", "key").agg(F.count("*").alias("n")), "rows")
    first = held.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("first"))
    is_first = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    told = materialise(held.join(first, "root").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), (~is_first).alias("_gone"), ((F.col("n") > 1) & is_first).alias("_again")).where("_gone or _again"), "gone")
    discard(held)
    names = fresh_names(df, "id", "key")
    row = df.withColumns({names[0]: df[id_col].cast("long"), names[1]: F.xxhash64(text_bytes(df, text_col)) if text_key is None else text_key})

    def of(table: DataFrame, how: str) -> DataFrame:
        return row.join(table, (row[names[0]] == table["_id"]) & (row[names[1]] == table["_key"]), how)

    if told.where("_again").isEmpty():
        return of(small(told), "left_anti").select(df.columns)
    again = of(small(told.where("_again")), "left_semi")
    one = again.groupBy(*names).agg(F.min_by(F.struct(*[again[c] for c in df.columns]), F.xxhash64(*[F.to_json(F.struct(again[c])) for c in df.columns])).alias("_row"))
    return of(small(told), "left_anti").select(df.columns).union(one.select(*[F.col("_row").getField(c).alias(c) for c in df.columns]))
