"""Quotation linking for conversations, in DataFrame functions only.

A message's lines are read with their quote levels (leading ``>`` marks); runs of lines of
one level are passages.  Texts are normalised (lower case, runs of anything but letters and
digits as one blank) and hashed in units that survive other line breaks and partial quotes:
every five words in a row of the joined text; a passage of fewer words is one unit, and meets
lines and messages of just these words.  A passage belongs to the earlier message that has
most of its units, at least half of them, whatever other messages repeat; a message answers the one that its largest first-level passage belongs to.  Threads
are found by pointer doubling over these answers; ordering by (conv_id, thread_turn, turn)
gives each conversation in reply order, without its quotations.

Defined results: a null text is an empty one; a message without a conversation or a turn is
kept, unlinked, with a thread of its own; rows with the same conversation and turn are one
message for linking, and each row gets the same links; a quotation of a later message, or
of none, stays unlinked; of two messages that have as much of a passage the earlier one has
it, of equally large passages the later one's message is answered; other columns, whatever their names,
aren't looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylog.llm.common import discard, materialise

COVER, SHINGLE = 0.5, 5
_MARKS = r"^((?:[ \t]*>)+)"
_WROTE = r"(?i)^.{0,300}\b(?:wrote|writes|schrieb|écrit|a écrit|escribió)\s*:\s*$"
_EMPTY = "array<struct<level: int, lines: array<string>>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, not at each place where it stands."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def read_lines(text: Column) -> Column:
    """(level, content) of each line."""

    def line(x: Column) -> Column:
        marks = F.regexp_extract(x, _MARKS, 1)
        level = F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))
        return F.struct(level.cast("int").alias("level"), F.when(level > 0, F.regexp_replace(x, _MARKS + r"[ \t]?", "")).otherwise(x).alias("content"))

    return F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), line)


def passages(lines: Column) -> Column:
    """Runs of lines of one level above 0, as (level, normalised lines that aren't empty)."""
    last = F.size(lines)
    starts = F.filter(F.sequence(F.lit(1), last), lambda k: (k == 1) | (F.element_at(lines, k)["level"] != F.element_at(lines, F.greatest(k - 1, F.lit(1)))["level"]))

    def run(starts: Column) -> Column:
        def one(k: Column) -> Column:
            first = F.element_at(starts, k)
            stop = F.coalesce(F.try_element_at(starts, k + 1), last + 1)
            own = F.transform(F.slice(lines, first, stop - first), lambda x: normal(x["content"]))
            return F.struct(F.element_at(lines, first)["level"].alias("level"), F.filter(own, lambda x: x != "").alias("lines"))

        return F.transform(F.sequence(F.lit(1), F.size(starts)), one)

    return F.filter(let(starts, run), lambda p: (p["level"] > 0) & (F.size(p["lines"]) > 0))


def body(lines: Column) -> Column:
    """The lines that aren't quoted, without the line that introduces a quotation."""
    own = F.filter(lines, lambda x, k: (x["level"] == 0) & ~(F.rlike(x["content"], F.lit(_WROTE)) & (F.coalesce(F.try_element_at(lines, k + 2)["level"], F.lit(0)) > 0)))
    return F.trim(F.array_join(F.transform(own, lambda x: x["content"]), "\n"))


def parsed(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", **more: str) -> DataFrame:
    """(conv_id, turn, any of ``more``, body, quotes) of each row; texts without a mark pass through."""
    text = F.coalesce(df[text_col], F.lit(""))
    quoted = F.contains(text, F.lit(">"))
    both = let(read_lines(text), lambda lines: F.struct(body(lines).alias("body"), passages(lines).alias("quotes")))
    plain = F.struct(text.alias("body"), F.array().cast(_EMPTY).alias("quotes"))
    found = df.select(df[conv_col].alias("conv_id"), df[turn_col].alias("turn"), *[df[c].alias(n) for n, c in more.items()], F.when(quoted, both).otherwise(plain).alias("_p"))
    return found.select("conv_id", "turn", *more, "_p.body", "_p.quotes")


def units(text: Column) -> Column:
    """Hashes of every SHINGLE words in a row of a normalised text; of a shorter one, of the whole."""
    words = F.split(text, " ")

    def rows(words: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (SHINGLE - 1), F.lit(1))), lambda k: F.xxhash64(F.array_join(F.slice(words, k, SHINGLE), " ")))
        return F.array_distinct(every)

    return let(words, rows)


def short_lines(lines: Column) -> Column:
    """Hashes of the normalised lines that have too few words for a row of SHINGLE."""
    return F.transform(F.filter(lines, lambda x: (x != "") & (F.size(F.split(x, " ")) < SHINGLE)), lambda x: F.xxhash64(x))


def linked_passages(messages: DataFrame, cover: float = COVER) -> DataFrame:
    """(conv_id, turn, level, passage, origin, share, chars): the different passages and where they belong (null: nowhere).

    The origin is the earlier message that has most of the passage's units, ``cover`` of them
    at least, the first of equals.  A message that has so many has one of the passage's rarest
    ones, so these lead to the candidates, whose units are then compared as a whole.  Equal
    passages of a conversation are looked up once, and of equal messages the first stands for
    all; of what is found only the first message of each share counts, a list no longer than
    the passage, from which each quotation takes the best one before it.
    """
    known = messages.where("conv_id is not null and turn is not null")
    names = ["conv_id", "turn", "level", "passage"]
    quotes = known.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.level", F.array_join("q.lines", " ").alias("whole"))
    quotes = quotes.select("conv_id", "turn", "level", F.unhex(F.md5("whole")).alias("passage"), F.length("whole").cast("long").alias("chars"), units(F.col("whole")).alias("units"))
    quotes = materialise(quotes.dropDuplicates(names), "passages")
    if quotes.isEmpty():
        return quotes.select(*names, F.lit(None).cast("long").alias("origin"), F.lit(None).cast("double").alias("share"), "chars")
    wanted = materialise(quotes.groupBy("conv_id", "passage").agg(F.first("units").alias("units"), F.max("turn").alias("last")), "wanted")
    own = known.join(wanted.select("conv_id").distinct(), "conv_id", "left_semi")
    lines = F.filter(F.transform(F.split("body", "\n"), normal), lambda x: x != "")
    own = own.select("conv_id", F.col("turn").alias("origin"), let(lines, lambda x: F.array_distinct(F.concat(units(F.array_join(x, " ")), short_lines(x)))).alias("held"))
    parts = materialise(own.select("conv_id", "origin", F.explode("held").alias("unit")).distinct(), "units")
    # of messages with the same units the first one is kept
    same = [F.bit_xor(F.xxhash64("unit", F.lit(k))).alias(f"sum_{k}") for k in (1, 2)]
    sums = parts.groupBy("conv_id", "origin").agg(F.count("*").alias("n"), *same)
    firsts = sums.groupBy("conv_id", "n", "sum_1", "sum_2").agg(F.min("origin").alias("origin")).select("conv_id", "origin")
    own = materialise(parts.join(firsts, ["conv_id", "origin"], "left_semi"), "messages")
    discard(parts)
    parts = own
    often = parts.groupBy("conv_id", "unit").agg(F.count("*").alias("often"))
    asked = wanted.select("conv_id", "passage", "last", F.explode("units").alias("unit")).join(often, ["conv_id", "unit"], "left")
    ranked = asked.groupBy("conv_id", "passage", "last").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "unit"))).alias("ranked"))
    rarest = F.slice("ranked", F.lit(1), (F.size("ranked") - F.ceil(F.size("ranked") * cover) + 1).cast("int"))
    leads = ranked.select("conv_id", "passage", "last", F.explode(rarest).alias("lead")).where("lead.often > 0").select("conv_id", "passage", "last", "lead.unit")
    candidates = leads.join(parts, ["conv_id", "unit"]).where("origin < last").select("conv_id", "passage", "origin").distinct()
    asked = candidates.join(wanted.select("conv_id", "passage", F.size("units").alias("n"), F.explode("units").alias("unit")), ["conv_id", "passage"])
    counts = asked.join(parts, ["conv_id", "origin", "unit"]).groupBy("conv_id", "passage", "origin").agg((F.count("*") / F.first("n")).alias("share"))
    shares = counts.where(F.col("share") >= cover)
    first = shares.groupBy("conv_id", "passage", "share").agg(F.min("origin").alias("origin"))
    found = first.groupBy("conv_id", "passage").agg(F.collect_list(F.struct("share", (-F.col("origin")).alias("early"))).alias("found"))
    best = F.array_max(F.filter("found", lambda x: -x["early"] < F.col("turn")))
    linked = quotes.select(*names, "chars").join(found, ["conv_id", "passage"], "left").withColumn("best", best)
    linked = materialise(linked.select(*names, (-F.col("best.early")).alias("origin"), "best.share", "chars"), "passages")
    discard(quotes, wanted, own)
    return linked


def roots(answers: DataFrame) -> DataFrame:
    """(conv_id, turn, root) from (conv_id, turn, parent), parents being earlier turns."""
    found = materialise(answers.select("conv_id", "turn", F.col("parent").alias("root")), "threads")
    while True:
        up = found.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("higher"))
        moved = materialise(found.join(up, ["conv_id", "root"], "left").select("conv_id", "turn", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")), "threads")
        discard(found)
        found = moved
        if moved.where("moved").isEmpty():
            return moved.select("conv_id", "turn", "root")


def conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", cover: float = COVER) -> DataFrame:
    """(conv_id, thread_turn, turn, parent_turn, role, body, n_quotes, n_linked, max_level) for each row of ``df``."""
    messages = parsed(df, conv_col, turn_col, text_col, role=role_col)
    links = linked_passages(messages, cover)
    # the largest first-level passage, the later message of equal ones
    parent = F.max(F.when((F.col("level") == 1) & F.col("origin").isNotNull(), F.struct("chars", "origin")))["origin"]
    linked = materialise(links.groupBy("conv_id", "turn").agg(parent.alias("parent"), F.count("origin").alias("n_linked")), "answers")
    threads = roots(linked.where("parent is not null"))
    known = linked.join(threads, ["conv_id", "turn"], "left").select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), "parent", "n_linked", "root")
    joined = messages.join(known, (F.col("conv_id") == F.col("_conv")) & (F.col("turn") == F.col("_turn")), "left")
    levels = F.coalesce(F.array_max(F.transform("quotes", lambda q: q["level"])), F.lit(0))
    return joined.select(
        "conv_id", F.coalesce("root", "turn").alias("thread_turn"), "turn", F.col("parent").alias("parent_turn"), "role", "body",
        F.size("quotes").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), levels.alias("max_level"),
    )


def reply_order(found: DataFrame) -> DataFrame:
    """The messages of ``conversations`` in reply order: threads by their first turn, each message after the one it answers."""
    return found.orderBy(F.col("conv_id").asc_nulls_last(), F.col("thread_turn").asc_nulls_last(), F.col("turn").asc_nulls_last())
