"""Near-duplicate groups at a Jaccard similarity of word shingles: SimHash first, then fast sketches.

Texts with the same shingles are one node.  SimHash fingerprints of the shingle sets go
through the binary-trie self-join; its links, few bits apart, are confirmed on the full sets.
Texts at the stated similarity can differ in more bits than a trie can follow at scale, so
what lies further apart is found by sketches of the same sets: bands of their coordinates, of
which a pair at the similarity shares none with a computed probability of 7e-6, hubs, and
comparison in blocks, as ``fast_sketches`` says.  Every link is confirmed by the exact
similarity of the two sets (64-bit hashes of the shingles).

Defined results: a null text is an empty one, and texts without words are alike; which row
of a group stays is as in ``simhash.first_of``; a null id takes part in links but names no
group; other columns, whatever their names, pass through; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylog.llm import simhash
from tallylog.llm.common import by_heavy_keys, discard, materialise
from tallylog.llm.fast_sketches import Rule, linked, nodes, text_key

RULE = Rule(shingle=5, share=80, bands=30, rows=5)


def print_pairs(classes: DataFrame) -> DataFrame:
    """(u, v): pairs of nodes by the trie, of fingerprints within its budget and of nodes that share one."""
    prints = materialise(classes.groupBy("fp").agg(F.min("node").alias("first")), "prints")
    forest = simhash.trie_links(prints.select("fp"), prints.count())
    ends = forest.join(prints.select(F.col("fp").alias("u"), F.col("first").alias("a")), "u").join(prints.select(F.col("fp").alias("v"), F.col("first").alias("b")), "v")
    same = classes.join(prints, "fp").where("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    pairs = materialise(ends.select(F.col("a").alias("u"), F.col("b").alias("v")).union(same), "pairs")
    discard(prints)
    return pairs


def rooted_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = RULE) -> DataFrame:
    """(doc_id, key, root) for each row of ``df``: rows of one group share ``root``."""
    docs = materialise(nodes(df, id_col, text_col, rule, prints=True), "nodes")
    named = docs.groupBy("node").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("buckets").alias("buckets"), F.first("fp").alias("fp"), F.count("*").alias("rows"))
    classes = materialise(named, "classes")
    tried = print_pairs(classes)
    roots = linked(df, text_col, rule, classes, tried)
    told = materialise(classes.join(roots, "node", "left").select("node", "rows", F.coalesce("root", "node").alias("root")), "roots")
    found = materialise(by_heavy_keys(docs.select("doc_id", "key", "node"), told, "node", "rows").select("doc_id", "key", "root"), "groups")
    discard(docs, classes, tried, roots, told)
    return found


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = RULE) -> DataFrame:
    """(doc_id, component_id) for each row of ``df``: the smallest id of its group."""
    rows = rooted_rows(df, id_col, text_col, rule)
    names = materialise(rows.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows")), "classes")
    return by_heavy_keys(rows, names, "root", "rows").select("doc_id", "component_id")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = RULE) -> DataFrame:
    """Rows of ``df`` that stay when one row of each group does."""
    return simhash.first_of(df, rooted_rows(df, id_col, text_col, rule), id_col, text_col, text_key(df, text_col))
