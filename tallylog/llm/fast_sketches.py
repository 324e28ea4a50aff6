"""Near-duplicates by fast similarity sketching, banding and exact verification.

Each text is the set of its word shingles (64-bit hashes).  A sketch is filled in rounds: in each round every element falls into one bin, with a value that later
rounds can't undercut; once all bins are full no further round is run, and rounds after the
first COORDINATES ones fill one bin each, so every coordinate fills.  A large set needs one
round, and agreement of coordinates is at least as concentrated about the Jaccard similarity
as with independent MinHash values.

Bands of its coordinates put sets into buckets: a pair at the similarity of 0.85 shares
no bucket with a computed probability of 7e-7.  Of a bucket not all pairs are made.  Its
members are compared with its hub, the set that shares buckets with most others; then, round
by round, with a hub among those outside its largest component.  Once that links little more,
the members outside a bucket's largest component are compared with all of its members, block
by block, but for sets that cannot be similar to any because of the shingles that no other
set has, an exact bound.  Every link is confirmed on the full sets, in whole numbers.

Defined results: a null text is an empty one; a text without words has an empty set and links
with nothing; texts with fewer words than a shingle has are one shingle; rows that share an
id each get their own set, and are one component only if their sets link; a null id takes part
in links but names no component unless the component has no other id (then it is null, as is
``kept``).  Columns other than the id and the text, whatever their names, are not looked at; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylog.llm import simhash
from tallylog.llm.common import batches, by_heavy_keys, discard, let_go, materialise, small, text_bytes
from tallylog.llm.text_codes import shingle_sets



class Rule(NamedTuple):
    """What links: sets of ``shingle`` words in a row of which ``share`` hundredths are common; looked for in ``bands`` of ``rows`` coordinates."""

    shingle: int = 3
    share: int = 85
    bands: int = 30
    rows: int = 6


RULE = Rule()
#: rounds with hubs at most, before all pairs that are left are compared
HUB_ROUNDS = 4
#: elements that are dealt to bins or counted together
SLICE = 1 << 18
#: bytes of sets that are compared with as many others in one task
BLOCK_BYTES = 2 << 20
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_VALUE_BITS = np.uint64(40)


def _dealt(hashes: np.ndarray, turn: int) -> np.ndarray:
    """A fresh 64-bit hash of every element for round ``turn``."""
    mixed = (hashes ^ np.uint64((turn * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & (2**64 - 1))) * _FIRST
    mixed ^= mixed >> np.uint64(32)
    mixed *= _SECOND
    return mixed ^ (mixed >> np.uint64(29))


def sketches(sets: list[np.ndarray], size: int = RULE.bands * RULE.rows) -> np.ndarray:
    """A row of ``size`` values for each set; those of an empty set are all ones."""
    full = np.full(len(sets) * size, np.iinfo(np.uint64).max, np.uint64)
    lengths = np.fromiter(map(len, sets), np.int64, len(sets))
    active = np.flatnonzero(lengths)
    for turn in range(2 * size):
        if not len(active):
            break
        forced = turn - size
        for first in _runs(lengths[active]):
            rows = active[first]
            owner = np.repeat(rows * size, lengths[rows])
            mixed = _dealt(np.concatenate([sets[k] for k in rows]), turn)
            # the upper bits choose the bin, the lower ones the value
            bins = ((mixed >> _VALUE_BITS) * np.uint64(size) >> np.uint64(24)).astype(np.int64) if forced < 0 else forced
            value = (mixed & np.uint64((1 << 40) - 1)) | (np.uint64(turn) << _VALUE_BITS)
            np.minimum.at(full, owner + bins, value)
        unfilled = (full.reshape(-1, size)[active] == np.iinfo(np.uint64).max).any(1)
        active = active[unfilled]
    return full.reshape(-1, size)


def _runs(lengths: np.ndarray) -> list[slice]:
    """Runs of sets of about SLICE elements together."""
    total, found, first = np.cumsum(lengths), [], 0
    while first < len(lengths):
        upto = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + SLICE, "right")))
        found.append(slice(first, upto))
        first = upto
    return found


def band_keys(found: np.ndarray, bands: int = RULE.bands) -> np.ndarray:
    """One bucket a band for each sketch."""
    parts = found.reshape(len(found), bands, -1)
    key = np.arange(bands, dtype=np.uint64)[None, :] * _SECOND + np.uint64(1)
    for k in range(parts.shape[2]):
        key = (key ^ parts[:, :, k]) * _FIRST
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def set_name(hashes: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    return xxhash.xxh3_128_digest(hashes.tobytes())


def bits_of(hashes: np.ndarray) -> int:
    """SimHash of a set: the bits that over half of its hashes have, as a signed number."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def text_key(df: DataFrame, text_col: str) -> F.Column:
    """128 bits that tell texts apart."""
    return F.unhex(F.md5(text_bytes(df, text_col)))


def nodes(df: DataFrame, id_col: str, text_col: str, rule: Rule, prints: bool = False) -> DataFrame:
    """(doc_id, key, node, n, buckets) for each row of ``df``, with ``prints`` also its SimHash ``fp``; ``key`` tells texts apart, empty sets have no buckets."""

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in rows:
            texts = batch.column(2).to_pylist()
            for s in batches(texts):
                held, own = shingle_sets(texts[s], rule.shingle), batch.slice(s.start, s.stop - s.start)
                keys = band_keys(sketches(held, rule.bands * rule.rows), rule.bands).tolist()
                columns = [own.column(0), own.column(1), pa.array([set_name(h) for h in held], pa.binary()), pa.array([len(h) for h in held], pa.int64()), pa.array([k if len(h) else [] for k, h in zip(keys, held, strict=True)], pa.list_(pa.int64()))]
                if prints:
                    columns.append(pa.array([bits_of(h) for h in held], pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "node", "n", "buckets", "fp"][: len(columns)])

    slim = df.select(df[id_col].cast("long").alias("doc_id"), text_key(df, text_col).alias("key"), text_bytes(df, text_col).alias("text"))
    return slim.mapInArrow(each, "doc_id long, key binary, node binary, n long, buckets array<long>" + ", fp long" * prints)


def full_sets(df: DataFrame, wanted: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """(node, held): the sorted hashes of the sets of ``wanted`` (key, node); of equal texts one is read."""

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in rows:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for s in batches(texts):
                yield pa.RecordBatch.from_arrays([pa.array(names[s], pa.binary()), pa.array([h.tobytes() for h in shingle_sets(texts[s], shingle)], pa.binary())], names=["node", "held"])

    keyed = df.select(text_key(df, text_col).alias("key"), text_bytes(df, text_col).alias("text")).join(small(wanted), "key")
    whole = keyed.groupBy("node").agg(F.first("text").alias("text"))
    return materialise(whole.mapInArrow(each, "node binary, held binary"), "sets")


def similar(a: np.ndarray, b: np.ndarray, share: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= share * (len(a) + len(b) - both)


def confirmed(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar."""

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in rows:
            a, b = (map(lambda x: np.frombuffer(x.as_py(), np.uint64), batch.column(k)) for k in (2, 3))
            near = pa.array([similar(x, y, share) for x, y in zip(a, b, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(near)

    one, two = (sets.select(F.col("node").alias(n), F.col("held").alias(h)) for n, h in (("u", "a"), ("v", "b")))
    return materialise(pairs.join(two, "v").join(one, "u").select("u", "v", "a", "b").mapInArrow(each, "u binary, v binary"), "links")


def by_size(share: int) -> F.Column:
    """Whether sets of ``n`` and ``_n`` shingles can be similar."""
    return F.least("n", "_n") * 100 >= F.greatest("n", "_n") * share


def outside(held: DataFrame) -> DataFrame:
    """``held`` (bucket, node, root, ...) with the bucket's largest component ``top``."""
    parts = held.groupBy("bucket", "root").agg(F.count("*").alias("_m"))
    tops = parts.groupBy("bucket").agg(F.max(F.struct("_m", "root"))["root"].alias("top"))
    return held.join(tops, "bucket")


def to_hubs(held: DataFrame, of_others: bool, share: int) -> DataFrame:
    """(u, v): each set with the hub of another component, of its buckets' hubs, with which it shares most buckets.

    A bucket's hub is its member with the greatest score; ``of_others``: among those outside
    its largest component.
    """
    fresh = outside(held)
    able = fresh.where("root <> top") if of_others else fresh
    hubs = able.groupBy("bucket").agg(F.max(F.struct("score", "node", "root", "n")).alias("hub")).select("bucket", F.col("hub.node").alias("u"), F.col("hub.root").alias("_root"), F.col("hub.n").alias("_n"))
    met = held.join(hubs, "bucket").where((F.col("root") != F.col("_root")) & by_size(share))
    shared = met.groupBy("node", "u").agg(F.count("*").alias("m"))
    best = shared.groupBy("node").agg(F.max(F.struct("m", "u"))["u"].alias("u"))
    return materialise(best.select("u", F.col("node").alias("v")), "pairs")


def reach(held: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, most): how many shingles of a set another one of ``held`` has; it has no more in common with any."""

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for node, held in zip(batch.column(0), batch.column(1), strict=True):
                own = np.frombuffer(held.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([node.as_py()] * len(own), pa.binary()), pa.array(own)], names=["node", "hash"])

    own = sets.join(held.select("node").distinct(), "node", "left_semi").mapInArrow(each, "node binary, hash long")
    alone = own.groupBy("hash").agg(F.count("*").alias("m"), F.min("node").alias("node")).where("m = 1").groupBy("node").agg(F.count("*").alias("alone"))
    return materialise(alone, "reach")


def near_in_block(names: list[bytes], roots: list[bytes], sets: list[np.ndarray], fresh: list[bool], share: int) -> list[tuple[bytes, bytes]]:
    """The similar pairs of a fresh set with any other one of another component, by common hashes counted for many pairs at once."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    whole, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    order = np.argsort(whole, kind="stable")
    whole, owner = whole[order], owner[order]
    root = np.unique(roots, return_inverse=True)[1]
    found = []
    for i in np.flatnonzero(fresh).tolist():
        first, last = np.searchsorted(whole, sets[i]), np.searchsorted(whole, sets[i], "right")
        both = np.zeros(len(sets), np.int64)
        for k in _runs(last - first):
            size = last[k] - first[k]
            at = np.repeat(first[k] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
            both += np.bincount(owner[at], minlength=len(sets))
        near = (100 * both >= share * (n[i] + n - both)) & (root != root[i])
        found += [(min(names[i], names[j]), max(names[i], names[j])) for j in np.flatnonzero(near).tolist()]
    return found


def compared(held: DataFrame, alone: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """(u, v): the similar pairs among all sets of different components that share a bucket.

    A bucket's sets outside its largest component are compared with all of its sets, in blocks
    of about BLOCK_BYTES of either; small buckets go together.  No rows of pairs are made but
    of those that are similar.
    """
    able = held.join(alone, "node", "left").where((F.col("n") - F.coalesce("alone", F.lit(0))) * 100 >= F.col("n") * share)
    told = outside(able.select("bucket", "node", "root", "n")).withColumn("fresh", F.col("root") != F.col("top")).drop("top")
    size = lambda c: F.sum(F.when(c, F.col("n"))) * 8
    blocks = told.groupBy("bucket").agg(size(F.col("fresh")).alias("some"), size(F.lit(True)).alias("all")).where("some > 0")
    blocks = materialise(blocks.withColumns({"rows": F.ceil(F.col("some") / BLOCK_BYTES), "columns": F.ceil(F.col("all") / BLOCK_BYTES)}), "blocks")
    together = max(1, -(-(blocks.agg(F.sum("all")).first()[0] or 0) // BLOCK_BYTES))
    dealt = told.join(blocks, "bucket").withColumn("group", F.when(F.col("all") * 16 > BLOCK_BYTES, F.col("bucket")).otherwise(F.pmod(F.xxhash64("bucket"), F.lit(together))))
    of = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    each_of = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    # a fresh set meets every block of the bucket's sets, and the sets of a block every block of fresh ones
    left = dealt.where("fresh").select("group", "bucket", "node", "root", "fresh", of("rows").alias("row"), F.explode(each_of("columns")).alias("column"))
    right = dealt.select("group", "bucket", "node", "root", F.lit(False).alias("fresh"), F.explode(each_of("rows")).alias("row"), of("columns").alias("column"))

    def compare(table: pa.Table) -> pa.Table:
        let_go()
        found: set[tuple[bytes, bytes]] = set()
        table = table.sort_by("bucket")
        bucket = table.column("bucket").to_numpy()
        edge = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)).tolist()
        for first, last in zip(edge[:-1], edge[1:], strict=True):
            part = table.slice(first, last - first)
            fresh = part.column("fresh").to_pylist()
            if any(fresh) and not all(fresh):
                found.update(near_in_block(part.column("node").to_pylist(), part.column("root").to_pylist(), [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column("held")], fresh, share))
        return pa.table({"u": pa.array([u for u, _ in found], pa.binary()), "v": pa.array([v for _, v in found], pa.binary())})

    both = left.unionByName(right).join(sets, "node").select("group", "bucket", "node", "root", "fresh", "row", "column", "held")
    links = materialise(both.groupBy("group", "row", "column").applyInArrow(compare, "u binary, v binary").distinct(), "links")
    discard(blocks)
    return links


def linked(df: DataFrame, text_col: str, rule: Rule, classes: DataFrame, tried: DataFrame | None = None) -> DataFrame:
    """(node, root) of all sets that link with another; ``classes``: (node, key, n, buckets), ``tried``: pairs (u, v) to begin with."""
    members = classes.select("node", "n", F.explode("buckets").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    met = materialise(members.join(shared, "bucket").select("bucket", "node", "n", "m"), "buckets")
    scores = materialise(met.groupBy("node").agg(F.sum("m").alias("score")), "scores")
    names = scores.select("node") if tried is None else scores.select("node").union(tried.select("u")).union(tried.select("v")).distinct()
    wanted = materialise(classes.select("key", "node").join(names, "node"), "wanted")
    sets = full_sets(df, wanted, text_col, rule.shingle)
    found: list[DataFrame] = []
    roots = None

    def split() -> DataFrame:
        """Members of the buckets that hold several components."""
        own = met.select("bucket", "node", "n")
        own = own.withColumn("root", F.col("node")) if roots is None else own.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        parted = own.groupBy("bucket").agg((F.min("root") != F.max("root")).alias("split")).where("split").select("bucket")
        return materialise(own.join(parted, "bucket", "left_semi").join(scores, "node"), "members")

    def take(more: DataFrame) -> int:
        """Take confirmed links in; how many there are."""
        nonlocal roots
        n = more.count()
        if n:
            found.append(more)
            before, roots = roots, materialise(simhash.components(reduce(DataFrame.union, found)), "roots")
            if before is not None:
                discard(before)
        return n

    if tried is not None:
        take(confirmed(tried, sets, rule.share))
    held = split()
    for turn in range(HUB_ROUNDS):
        pairs = to_hubs(held, turn > 0, rule.share)
        asked, linking = pairs.count(), take(confirmed(pairs, sets, rule.share))
        discard(pairs)
        if linking:
            discard(held)
            held = split()
        # few new links tell that what is left is apart
        if 20 * linking < asked or not asked:
            break
    alone = reach(held, sets)
    take(compared(held, alone, sets, rule.share))
    discard(met, scores, wanted, sets, held, alone, *found)
    return roots if roots is not None else classes.sparkSession.createDataFrame([], "node binary, root binary")


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = RULE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``df``."""
    docs = materialise(nodes(df, id_col, text_col, rule), "nodes")
    named = docs.where("n > 0").groupBy("node").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("buckets").alias("buckets"), F.min("doc_id").alias("first_id"), F.count("*").alias("rows"))
    classes = materialise(named, "classes")
    roots = linked(df, text_col, rule, classes)
    rooted = materialise(classes.join(roots, "node", "left").select("node", "first_id", "rows", F.coalesce("root", "node").alias("root")), "classes")
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    told = materialise(rooted.join(names, "root").select("node", "rows", "component_id"), "names")
    discard(classes, rooted, roots)
    some = by_heavy_keys(docs.where("n > 0").select("doc_id", "n", "node"), told, "node", "rows").select("doc_id", "n", "component_id")
    whole = some.unionByName(docs.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return whole.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
