"""Conversations from messages that quote each other.

Lines that begin with ``>`` are quotations, nested by the number of marks.  Every quoted passage
is normalised and hashed, as a whole and by lines and sentences, so that quotations wrapped anew
are found as well, and joined to the message that first said it; the passages a message quotes
directly say which message it answers.  Replies then follow what they answer, without the
quotations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from autoprofile.llm.common import column, running_sums, settle

#: the marks a quoted line begins with
MARKS = r"^(?:[ \t]*>)+"
HAS_QUOTES = r"(?m)^[ \t]*>"
#: a line that announces a quotation: "On ... wrote:"
ANNOUNCED = r"^(?i)(?:on\b.*\bwrote|.{1,80}\bwrote):\s*$"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _lines(text: Column) -> Column:
    """(level, content) of each line; level 0 is the message's own."""

    def line(whole: Column) -> Column:
        marks = F.regexp_extract(whole, MARKS, 0)
        level = F.length(F.regexp_replace(marks, "[^>]", ""))
        own = F.when(level > 0, F.regexp_replace(whole, MARKS + "[ \t]?", "")).otherwise(whole)
        return F.struct(level.alias("level"), own.alias("content"))

    return F.transform(F.split(text, "\r?\n"), line)


def passages(text: Column) -> Column:
    """The runs of lines of one level: (level, content), in order."""

    def runs(lines: Column) -> Column:
        last = F.size(lines) - 1
        begins = F.filter(
            F.sequence(F.lit(0), last),
            lambda i: (i == 0)
            | (F.get(lines, i)["level"] != F.get(lines, i - 1)["level"]),
        )

        def run(starts: Column) -> Column:
            return F.transform(starts, lambda start, j: F.struct(
                F.get(lines, start)["level"].alias("level"),
                F.array_join(
                    F.transform(
                        F.slice(lines, start + 1,
                                F.coalesce(F.get(starts, j + 1), last + 1) - start),
                        lambda line: line["content"],
                    ),
                    "\n",
                ).alias("content"),
            ))

        return _once(begins, run)

    return _once(_lines(text), runs)


def normalised(text: Column) -> Column:
    """Lower case, runs of white space as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def passage_hash(text: Column) -> Column:
    """The hash of a normalised passage; NULL for a blank one."""
    plain = normalised(text)
    return F.when(plain != "", F.md5(plain))


def pieces(text: Column) -> Column:
    """The hashes a text is found by: of all of it, its lines and its sentences, none twice.

    Sentences do not depend on where lines are broken.
    """
    sentences = F.split(normalised(text), r"(?<=[.!?]) ")
    hashes = F.transform(
        F.concat(F.array(text), F.split(text, "\n"), sentences), passage_hash
    )
    return F.array_distinct(F.filter(hashes, lambda h: h.isNotNull()))


def own_text(found: Column) -> Column:
    """A message's own lines, without those that announce a quotation."""
    own = F.filter(found, lambda p: p["level"] == 0)
    text = F.array_join(F.transform(own, lambda p: p["content"]), "\n")
    kept = F.filter(F.split(text, "\n"), lambda line: ~line.rlike(ANNOUNCED))
    begun = F.regexp_replace(F.array_join(kept, "\n"), r"^\s*\n", "")
    return F.rtrim(begun, F.lit(" \t\n\x0b\x0c\r"))


def _messages(df: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, turn, role, own text, and the quoted passages; one row per row."""
    t = F.coalesce(column(df, text).cast("string"), F.lit(""))
    rows = df.select(
        column(df, conversation).alias("conv"), column(df, turn).alias("turn"),
        column(df, role).cast("string").alias("role"), t.alias("t"),
    )
    parts = F.when(F.col("t").rlike(HAS_QUOTES), passages(F.col("t")))
    rows = rows.withColumn("parts", parts)
    return settle(rows.select(
        "conv", "turn", "role",
        F.when(F.col("parts").isNull(), F.col("t")).otherwise(own_text(F.col("parts")))
        .alias("own"),
        F.filter("parts", lambda p: p["level"] > 0).alias("quoted"),
    ))


def _links(messages: DataFrame, most_conversations: int) -> DataFrame:
    """One row per quoted passage: conv, turn, number, level, content, and the conversation and
    turn that first said it (NULL where none did)."""
    quoted = settle(
        messages.filter(F.size("quoted") > 0)
        .select("conv", "turn", F.posexplode("quoted").alias("number", "p"))
        .select("conv", "turn", "number", "p.level", "p.content",
                pieces(F.col("p.content")).alias("pieces"))
    )
    # the first piece is the passage as a whole
    asked = quoted.select(
        "conv", "turn", "number", F.posexplode("pieces").alias("place", "hash")
    )
    wanted = asked.select("hash").distinct()
    said = messages.filter("conv IS NOT NULL AND turn IS NOT NULL").select(
        "conv", "turn", F.explode(pieces(F.col("own"))).alias("hash")
    )
    said = said.join(wanted, "hash", "left_semi")
    # the first message that said it: in each conversation, and of all; one row for each, so
    # a line that very many messages have joins like any other
    inside = settle(said.groupBy("conv", "hash").agg(F.min("turn").alias("first")))
    ever = inside.groupBy("hash").agg(
        F.min(F.struct("conv", "first")).alias("ever"), F.count(F.lit(1)).alias("conversations")
    )
    own = F.struct(F.col("conv"), F.col("first"))
    before = F.struct(F.col("conv"), F.col("turn").alias("first"))
    elsewhere = (F.col("conversations") <= most_conversations) & (F.col("ever") < before)
    found = (
        asked.join(inside, ["conv", "hash"], "left")
        .join(ever, "hash", "left")
        .select(
            "conv", "turn", "number", "place", "conversations",
            F.when(F.col("first") < F.col("turn"), own)
            .when(elsewhere, F.col("ever")).alias("source"),
        )
        .filter("source IS NOT NULL")
        .groupBy("conv", "turn", "number")
        .agg(F.min(F.struct(
            (F.col("place") > 0).alias("part"), "conversations", "place", "source"
        )).alias("best"))
        .select("conv", "turn", "number", F.col("best.source.conv").alias("source_conv"),
                F.col("best.source.first").alias("source_turn"))
    )
    return quoted.select("conv", "turn", "number", "level", "content").join(
        found, ["conv", "turn", "number"], "left"
    )


def quotation_links(
    df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text", most_conversations: int = 1,
) -> DataFrame:
    """One row per quoted passage: conversation, turn, passage, level, content, source_conv,
    source_turn.

    A passage comes from the message that first said it as a whole, else from the one that first
    said one of its lines or sentences, the rarest first, counted by the conversations that say
    it.  An earlier turn of the same conversation goes before all others.  A piece that more
    than ``most_conversations`` conversations say shows nothing beyond its own conversation, and
    another conversation is a source only if it comes earlier by its number.
    """
    found = _links(_messages(df, conversation, turn, role, text), most_conversations)
    return found.select(
        F.col("conv").alias(conversation), F.col("turn").alias(turn),
        F.col("number").alias("passage"), "level", "content", "source_conv", "source_turn",
    )


def _roots(links: DataFrame) -> DataFrame:
    """conv, turn, root_conv, root_turn, depth for every message that answers another.

    The way to the root doubles in every round, so rounds grow with the logarithm of the longest
    chain of replies.
    """
    ways = links.select(
        "conv", "turn", F.col("source_conv").alias("root_conv"),
        F.col("source_turn").alias("root_turn"), F.lit(1).cast("long").alias("depth"),
    )
    moved = True
    while moved:
        ways = settle(ways)
        further = ways.select(
            F.col("conv").alias("root_conv"), F.col("turn").alias("root_turn"),
            F.col("root_conv").alias("next_conv"), F.col("root_turn").alias("next_turn"),
            F.col("depth").alias("more"),
        )
        joined = ways.join(further, ["root_conv", "root_turn"], "left")
        moved = joined.filter("more IS NOT NULL").limit(1).count() > 0
        if moved:
            ways = joined.select(
                "conv", "turn",
                F.when(F.col("more").isNull(), F.col("root_conv"))
                .otherwise(F.col("next_conv")).alias("root_conv"),
                F.when(F.col("more").isNull(), F.col("root_turn"))
                .otherwise(F.col("next_turn")).alias("root_turn"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            )
    return ways


def reply_ordered(
    df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text", template: str = "<|%s|>\n%s\n", most_conversations: int = 1,
) -> DataFrame:
    """One row per message, in reply order: thread (the conversation of the message that all of
    it answers), position from 1 in the thread, conversation, turn, role, reply_to_conv,
    reply_to_turn, depth, content (without quotations), formatted, and of the passages it quotes
    at any level: quotes (how many), quotes_linked, deepest (level), origin_conv and origin_turn
    (who said the deepest linked one, the first of equals).

    A message answers the source of the first passage it quotes at level 1 and that can be
    linked (:func:`quotation_links`).  Where no level-1 passage is linked nothing is answered,
    and the message is a root at its place in its conversation.  Roots are in the order of their
    turns; after a root come its replies, by depth, then by turn.

    A null text counts as empty; a null role is written as ``none``.  Messages without
    conversation or turn are never answered; those without a conversation form one thread.  Rows
    that repeat a conversation and turn are rows of their own; what they quote is taken together,
    passages of one number as one.  Texts may be of any length, an empty table gives no rows, and
    other columns, whatever their names, are not looked at.
    """
    messages = _messages(df, conversation, turn, role, text)
    linked = F.col("source_conv").isNotNull()
    quotes = settle(
        _links(messages, most_conversations)
        .filter("conv IS NOT NULL AND turn IS NOT NULL")
        .groupBy("conv", "turn", "number")
        .agg(F.max("level").alias("level"),
             F.min(F.when(linked, F.struct("level", "source_conv", "source_turn"))).alias("x"))
        .groupBy("conv", "turn")
        .agg(
            F.count(F.lit(1)).alias("quotes"),
            F.count("x").alias("quotes_linked"),
            F.max("level").alias("deepest"),
            F.min(F.when(F.col("x.level") == 1, F.struct(
                "number", "x.source_conv", "x.source_turn"))).alias("answered"),
            F.min(F.when(F.col("x").isNotNull(), F.struct(
                (-F.col("x.level")).alias("up"), "number", "x.source_conv", "x.source_turn"
            ))).alias("origin"),
        )
    )
    links = quotes.filter("answered IS NOT NULL").select(
        "conv", "turn", "answered.source_conv", "answered.source_turn"
    )
    roots = _roots(links)
    threads = (
        messages.drop("quoted")
        .join(quotes, ["conv", "turn"], "left")
        .join(roots, ["conv", "turn"], "left")
        .select(
            "*", "answered.source_conv", "answered.source_turn",
            F.when(F.col("depth").isNull(), F.col("conv")).otherwise(F.col("root_conv"))
            .alias("thread"),
            F.when(F.col("depth").isNull(), F.col("turn")).otherwise(F.col("root_turn"))
            .alias("begin"),
            F.lit(1).cast("long").alias("place"),
        )
        .withColumn("depth", F.coalesce("depth", F.lit(0)))
    )
    ordered = running_sums(
        threads.withColumn("h", F.xxhash64("own", "role")),
        [F.col(c).asc_nulls_first() for c in ("thread", "begin", "depth", "conv", "turn", "h")],
        ["place"],
    )
    sizes = ordered.groupBy("thread").agg(F.min("place_until").alias("first"))
    sizes = settle(sizes.withColumnRenamed("thread", "of"))
    numbered = ordered.join(sizes, F.col("thread").eqNullSafe(F.col("of")))
    speaker = F.coalesce("role", F.lit("none"))
    return numbered.select(
        "thread",
        (F.col("place_until") - F.col("first") + 1).alias("position"),
        F.col("conv").alias(conversation), F.col("turn").alias(turn), F.col("role").alias(role),
        F.col("source_conv").alias("reply_to_conv"), F.col("source_turn").alias("reply_to_turn"),
        "depth", F.col("own").alias("content"),
        F.format_string(template, speaker, F.col("own")).alias("formatted"),
        F.coalesce("quotes", F.lit(0)).alias("quotes"),
        F.coalesce("quotes_linked", F.lit(0)).alias("quotes_linked"),
        F.coalesce("deepest", F.lit(0)).alias("deepest"),
        F.col("origin.source_conv").alias("origin_conv"),
        F.col("origin.source_turn").alias("origin_turn"),
    )


#: a quoted line is broken after this many characters
WRAPPED = 72


def as_replies(
    df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text",
) -> DataFrame:
    """The messages as mail: each quotes the whole message of the turn before, and at level 2 the
    one before that, then says its own text.  conversation, turn, role, text; a row per row.

    Even turns break the lines they quote anew.  Own lines that look like quotations get a space
    in front that is none of the white space before a mark.  A null text counts as empty; of
    rows that repeat a conversation and turn the least text is quoted; where the turn before is
    blank or has no row, and without conversation or turn, nothing is quoted.
    """
    own = F.regexp_replace(
        F.coalesce(column(df, text).cast("string"), F.lit("")), r"(?dm)^(?=[ \t]*>)", "\u00a0"
    )
    rows = df.select(
        column(df, conversation).alias("conv"), column(df, turn).alias("turn"),
        column(df, role).cast("string").alias("role"), own.alias("own"),
    )
    said = rows.groupBy("conv", "turn").agg(F.min("own").alias("said"))
    once = said.select("conv", (F.col("turn") + 1).alias("turn"), F.col("said").alias("one"))
    twice = said.select("conv", (F.col("turn") + 2).alias("turn"), F.col("said").alias("two"))

    def wrapped(value: Column) -> Column:
        flat = F.regexp_replace(value, r"\s+", " ")
        return F.rtrim(
            F.regexp_replace(flat, rf"(.{{1,{WRAPPED}}})(?: |$)", "$1\n"), F.lit("\n")
        )

    def marked(value: Column, marks: str) -> Column:
        shown = F.when(F.col("turn") % 2 == 0, wrapped(value)).otherwise(value)
        lines = F.regexp_replace(F.rtrim(shown, F.lit("\r\n")), r"(?dm)^", marks)
        return F.when(F.trim(value) != "", F.concat(lines, F.lit("\n")))

    announced = F.format_string("On turn %s they wrote:\n", F.col("turn") - 1)
    joined = rows.join(once, ["conv", "turn"], "left").join(twice, ["conv", "turn"], "left")
    quotation = F.concat(
        announced, F.coalesce(marked(F.col("two"), "> > "), F.lit("")), marked(F.col("one"), "> ")
    )
    return joined.select(
        F.col("conv").alias(conversation), F.col("turn").alias(turn), F.col("role").alias(role),
        F.concat(F.coalesce(quotation, F.lit("")), F.col("own")).alias(text),
    )
