"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Each document gets a rate: how often the mix takes it.  Of all rates in [0, 2] that meet the
token target of every source, the ones nearest to 1 by relative entropy are exponential
tilts, ``min(2, exp(lambda * size / scale))`` with one ``lambda`` a source; the dual is
convex and solved by safeguarded Newton steps.  A step needs sums over (source, size) with
the number of such documents, which is aggregated once; sums are taken in fixed point, so
their order doesn't matter and reruns agree.  Rates are rounded to copies by a hash of each
document against its fraction, shifted by one offset a source that brings the words taken
to the target; the offset is found in histograms of 2048 places, level by level, and one
document of the size nearest to the rest is then taken once more or less.

Defined results: a null text has size 0; a null source is a source of its own, the last one;
rows that share id, source and size are told apart by a number, so that they are rounded
one by one; documents of size 0 take 0 words; a source that is to be taken 2 times has rate
2 throughout; other columns, whatever their names, pass through; an empty table gives no
rows.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallylog.llm.common import discard, materialise

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"
#: fixed-point unit of sums, and what counts as met
_UNIT, _CLOSE = 1 << 20, 1e-9
#: bits of the rounding key, and of the places of one histogram
_KEY, _PLACE = 33, 11


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def exact_sum(value: Column) -> Column:
    return F.sum(F.round(value * _UNIT).cast("decimal(38,0)")).cast("double") / _UNIT


def ranked(totals: DataFrame) -> DataFrame:
    """``totals`` (source, ...) with ``sid``, the rank of the source by code point, null last; sorted in parts, not in one task."""
    last = F.col("source").asc_nulls_last()
    held = totals.repartitionByRange(last).sortWithinPartitions(last).withColumn("_at", F.monotonically_increasing_id())
    held = materialise(held, "sources").withColumn("_part", F.shiftright("_at", 33))
    parts = held.groupBy("_part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = held.join(parts.select("_part", before.alias("_before")), "_part")
    return placed.withColumn("sid", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_before")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, sid, source_size, target): weights by rank of the source, capped targets with the excess reshared.

    A level of words a unit of weight is raised until the sources below their caps share
    what the others, held at theirs, leave.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    held = materialise(ranked(totals).withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most)), "targets")
    level, before = 0.0, -1.0
    while level != before:
        before = level
        free = F.col("cap") > F.col("weight") * level
        found = held.agg(F.sum("source_size").cast("double"), exact_sum(F.when(~free, F.col("cap")).otherwise(0.0)), F.sum(F.when(free, F.col("weight")))).first()
        if not found[0] or not found[2]:
            break
        level = max(level, (found[0] * share - found[1]) / found[2])
    return held.select("source", "sid", "source_size", F.least("cap", F.col("weight") * level).alias("target"))


def tilt(size: Column, most: float = MOST) -> Column:
    """Rate of a document, from its source's ``lam`` and ``scale``."""
    return F.when(F.col("full"), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.exp(F.least(F.col("lam") * size / F.col("scale"), F.lit(50.0)))))


def solve(sizes: DataFrame, targets: DataFrame, most: float = MOST) -> DataFrame:
    """``targets`` with ``lam``, ``scale`` and ``full`` of each source."""
    counts = sizes.where("size > 0").join(targets.select(F.col("source").alias("_s"), "sid"), F.col("source").eqNullSafe(F.col("_s")))
    counts = materialise(counts.groupBy("sid", "size").agg(F.count("*").alias("n")), "sizes")
    scale = counts.groupBy("sid").agg((F.sum(F.col("n") * F.col("size").cast("decimal(38,0)") * F.col("size")).cast("double") / F.sum(F.col("n") * F.col("size"))).alias("scale"))
    state = targets.join(scale, "sid", "left").select(
        "sid", "target", F.coalesce("scale", F.lit(1.0)).alias("scale"), (F.col("target") >= F.col("source_size") * float(most) * (1 - 1e-12)).alias("full"),
        F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(False).alias("met"),
    )
    state = materialise(state, "dual")
    for turn in itertools.count():
        rate = tilt(F.col("size"), most)
        words = F.col("n") * F.col("size") * rate
        at = counts.join(state.where("not full and not met"), "sid").groupBy("sid").agg(
            exact_sum(words).alias("g"), exact_sum(F.when(rate < float(most), words * F.col("size") / F.col("scale")).otherwise(0.0)).alias("h")
        )
        over = F.col("g") > F.col("target")
        lo, hi = F.when(~over, F.col("lam")).otherwise(F.col("lo")), F.when(over, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - (F.col("g") - F.col("target")) / F.when(F.col("h") > 0, F.col("h"))
        # every third step halves the bracket, so the search ends whatever the shape of the dual
        inside = step.isNotNull() & F.lit(turn % 3 < 2) & (F.col("lo2").isNull() | (step > F.col("lo2"))) & (F.col("hi2").isNull() | (step < F.col("hi2")))
        safe = F.when(F.col("lo2").isNull(), F.col("lam") * 2 - 1).when(F.col("hi2").isNull(), F.col("lam") * 2 + 1).otherwise((F.col("lo2") + F.col("hi2")) / 2)
        near = F.abs(F.col("g") - F.col("target")) <= F.col("target") * _CLOSE
        moved = state.join(at, "sid", "left").withColumn("lo2", lo).withColumn("hi2", hi)
        done = F.col("met") | F.col("full") | F.col("g").isNull() | near | F.coalesce(F.col("hi2") - F.col("lo2") < 1e-13, F.lit(False))
        before, state = state, materialise(moved.select("sid", "target", "scale", "full", F.when(done, F.col("lam")).otherwise(F.when(inside, step).otherwise(safe)).alias("lam"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), done.alias("met")), "dual")
        discard(before)
        if state.where("not met").isEmpty():
            break
    return targets.join(state.select("sid", "lam", "scale", "full"), "sid")


IDENTITY = ("doc_id", "source", "size", "nth")


def repeats(sizes: DataFrame) -> DataFrame | None:
    """(_doc_id, _source, _size) that several rows of ``sizes`` share; None if there are none."""
    again = sizes.groupBy(*IDENTITY[:3]).count().where("count > 1").select(*[F.col(n).alias(f"_{n}") for n in IDENTITY[:3]])
    again = materialise(again, "repeats")
    return None if again.isEmpty() else again


def numbered(rows: DataFrame, again: DataFrame | None) -> DataFrame:
    """``rows`` (doc_id, source, size, any more) with ``nth``, which counts up the rows that share the first three.

    Only rows that aren't alone are looked at; they are counted by the partition that they
    come from first, so that one that is repeated without end needn't meet in one task.
    """
    if again is None:
        return rows.withColumn("nth", F.lit(0).cast("long"))
    names = list(IDENTITY[:3])
    held = rows.withColumn("_part", F.spark_partition_id())
    met = [held[n].eqNullSafe(again[f"_{n}"]) for n in names]
    some = held.join(again, met, "left_semi")
    parts = some.groupBy(*names, "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*names).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(n).alias(f"_{n}") for n in names], F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*names, "_part").orderBy(F.lit(0)))
    told = some.withColumn("_own", own).join(parts, [*[F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names], F.col("_part") == F.col("_of")])
    told = told.select(*rows.columns, (F.col("_before") + F.col("_own") - 1).alias("nth"))
    return held.join(again, met, "left_anti").select(*rows.columns, F.lit(0).cast("long").alias("nth")).union(told)


def round_key(rate: Column) -> Column:
    """Where the document's hash lies above its rate's fraction, as an integer of _KEY bits; documents that can't be taken once more have none."""
    unit = F.shiftrightunsigned(F.xxhash64(*IDENTITY, F.lit(4)), 64 - 32).cast("double") / float(1 << 32)
    place = F.floor((unit - (rate - F.floor(rate)) + 1) * float(1 << (_KEY - 1)))
    return F.when((rate < float(MOST)) & (F.col("size") > 0), place.cast("long"))


def tie_key() -> Column:
    """Tells documents of the same rounding key apart."""
    return F.xxhash64(F.lit(5), *IDENTITY)


def plan(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """What each source's documents need to be taken: (source, sid, source_size, target, lam, scale, full, cut, flip).

    ``sizes``: (doc_id, source, size, nth).  A document is taken floor(rate) times, and once
    more if its rounding key is below ``cut``; ``flip`` names the one that is held the other way.
    """
    solved = materialise(solve(sizes, materialise(source_targets(sizes, weights, share, most), "targets"), most), "mix")
    with_rates = sizes.join(solved.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).withColumn("rate", tilt(F.col("size"), most))
    base = with_rates.groupBy("sid").agg(F.sum(F.floor("rate") * F.col("size")).alias("base"))
    keyed = with_rates.select("sid", "size", round_key(F.col("rate")).alias("key"), tie_key().alias("tie")).where("key is not null")
    level = solved.join(base, "sid").select("sid", (F.round("target").cast("long") - F.col("base")).alias("need"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("words"))
    level = materialise(level, "rounding")
    for shift in range(_KEY - _PLACE, -1, -_PLACE):
        head = F.shiftright("key", shift + _PLACE) == F.col("prefix") if shift + _PLACE < _KEY else F.lit(True)
        bins = keyed.join(level, "sid").where(head).groupBy("sid", F.shiftright("key", shift).alias("place")).agg(F.sum("size").alias("size"))
        running = Window.partitionBy("sid").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
        upto = level.join(bins, "sid").withColumn("upto", F.col("words") + F.sum("size").over(running))
        # the place in which the running sum comes to half a step past the need: nearest at the last level
        reach = F.col("upto") - (F.col("size") / 2 if shift == 0 else F.lit(0))
        inside = upto.where(reach >= F.col("need")).groupBy("sid").agg(F.min(F.struct("place", F.col("upto") - F.col("size"))).alias("at"))
        end = F.shiftleft(F.col("prefix") + 1, _PLACE) if shift + _PLACE < _KEY else F.lit(1 << _PLACE).cast("long")
        level = level.join(inside, "sid", "left").select("sid", "need", F.coalesce("at.place", end).alias("prefix"), F.coalesce("at.col2", "words").alias("words"))
        level = materialise(level, "rounding")
    cuts = level.select("sid", "need", F.least(F.col("prefix"), F.lit(1 << _KEY).cast("long")).alias("cut"))
    # one document more or less, of the size nearest to what the offset leaves open
    words = keyed.join(cuts, "sid").where("key < cut").groupBy("sid").agg(F.sum("size").alias("words"))
    gap = materialise(cuts.join(words, "sid", "left").select("sid", "cut", (F.col("need") - F.coalesce("words", F.lit(0))).alias("gap")), "rounding")
    able = keyed.join(gap, "sid").where(F.when(F.col("gap") > 0, F.col("key") >= F.col("cut")).otherwise(F.col("key") < F.col("cut")))
    error = F.abs(F.col("size") - F.abs("gap"))
    best = able.where(error < F.abs("gap")).groupBy("sid").agg(F.min(F.struct(error.alias("error"), "key", "tie")).alias("best"))
    cuts = gap.join(best, "sid", "left").select("sid", "cut", F.struct("best.key", "best.tie").alias("flip"))
    return materialise(solved.join(cuts, "sid"), "mix")


def take(sized: DataFrame, mix: DataFrame, most: float = MOST) -> DataFrame:
    """``sized`` (doc_id, source, size, nth, any more) with sid, source_size, target, rate and copies."""
    joined = sized.join(mix.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).withColumn("rate", tilt(F.col("size"), most))
    key = round_key(F.col("rate"))
    flipped = F.coalesce((key == F.col("flip.key")) & (tie_key() == F.col("flip.tie")), F.lit(False))
    once_more = F.coalesce((key < F.col("cut")) != flipped, F.lit(False))
    copies = F.when(F.col("size") > 0, F.floor("rate") + once_more.cast("long")).otherwise(F.lit(0)).cast("long")
    return joined.withColumn("copies", copies).drop("_s", "lam", "scale", "full", "cut", "flip")


def sizes_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, source, size, nth) of each row, and what several rows share."""
    sizes = materialise(df.select(df[id_col].alias("doc_id"), df[source_col].alias("source"), word_count(df[text_col]).alias("size")), "sizes")
    again = repeats(sizes)
    if again is None:
        return numbered(sizes, None), None
    told = materialise(numbered(sizes, again), "sizes")
    discard(sizes)
    return told, again


def mix_report(df: DataFrame, **columns: str) -> DataFrame:
    """(doc_id, size, source_size, target, rate, copies, taken) for each row of ``df``."""
    sizes, _ = sizes_of(df, **columns)
    return take(sizes, plan(sizes)).select("doc_id", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``df`` that the mix takes, each as often as it does, with the same columns."""
    sizes, again = sizes_of(df, id_col, text_col, source_col)
    mix = plan(sizes)
    packed = df.select(df[id_col].alias("doc_id"), df[source_col].alias("source"), word_count(df[text_col]).alias("size"), F.struct(*[df[c] for c in df.columns]).alias("_row"))
    taken = take(numbered(packed, again), mix).where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return taken.select(*[F.col("_row").getField(c).alias(c) for c in df.columns])
