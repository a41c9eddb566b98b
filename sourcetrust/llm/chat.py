"""Conversations without quotes, by quotation linking, in DataFrame operations only.

A line's quote level is the number of `>` before its text. A message's lines at level 0 are its
body; neighbouring lines of one level above 0 are a quoted passage. Passages and bodies are cut to
units (the whole, its paragraphs, its lines), which are normalised and hashed. A unit belongs to
the first message of its conversation that has it in its body, so a join of quoted units with
these first messages yields one row per quoted unit at most, however common a line is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sourcetrust.llm.tables import Workspace, numbered

# fixed values: the quote sign with the blanks around it, and what counts as blank
QUOTE = r"^[ \t]*(>[ \t]*)+"
BLANK = r"[ \t\n]+"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    """The text with a backslash inside of what would read as a mark, so that no body opens a turn."""
    return F.regexp_replace(text, r"<(\\*)\|(im_start|im_end)\|>", r"<$1\\|$2|>")


def quote_lines(text: Column) -> Column:
    """Array of (level, content), one per line."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "\n")
    return F.transform(lines, lambda x: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(x, QUOTE, 0), "[^>]", "")).alias("level"),
        F.regexp_replace(x, QUOTE, "").alias("content"),
    ))


def body_of(lines: Column) -> Column:
    """The lines at level 0, without blank ones at either end."""
    own = F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["content"])
    return F.regexp_replace(F.array_join(own, "\n"), rf"\A{BLANK}|{BLANK}\z", "")


def passages_of(lines: Column) -> Column:
    """Array of (level, text) of the runs of lines with one level above 0."""
    level = lambda i: F.element_at(lines, i)["level"]
    places = F.sequence(F.lit(1), F.size(lines))
    first = F.filter(places, lambda i: (level(i) > 0) & ((i == 1) | (level(F.greatest(i - 1, F.lit(1))) != level(i))))
    last = F.filter(places, lambda i: (level(i) > 0) & (
        (i == F.size(lines)) | (level(F.least(i + 1, F.size(lines))) != level(i))
    ))
    return F.transform(F.arrays_zip(first.alias("a"), last.alias("b")), lambda r: F.struct(
        level(r["a"]).alias("level"),
        F.array_join(F.transform(F.slice(lines, r["a"], r["b"] - r["a"] + 1), lambda x: x["content"]), "\n").alias("text"),
    ))


def units_of(text: Column) -> Column:
    """Normalised units of a text, each once: lower case, blanks as one space, none empty."""
    raw = F.concat(F.array(text), F.split(text, r"\n[ \t]*\n"), F.split(text, "\n"))
    plain = F.transform(raw, lambda x: F.trim(F.lower(F.regexp_replace(x, BLANK, " "))))
    return F.filter(F.array_distinct(plain), lambda x: x != "")


def link_quotes(
    df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per message: conversation, turn, role, position, reply_to, n_quotes, n_linked, body, chat.

    `position` orders a conversation by turn, then role and text, nulls first, from 0. A passage is
    linked to the earlier message with most of its characters, the latest on ties. `reply_to` is the
    position of the message that the level-1 passages quote most, else of the message before, and
    null for the first; so a message always follows what it replies to. `body` is the text without
    quotes, `chat` the body between role marks, marks in the text escaped; chats in order of position are the conversation. They
    stay rows, as a conversation may be longer than a task can hold. Null text counts as empty, a
    null role shows as empty, rows with a null conversation form one, repeated rows are messages
    each. Other columns are not read. An empty table gives no rows.
    """
    space = Workspace(df.sparkSession, "chat")
    rows = df.select(
        F.col(conversation).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")
    )
    order = [F.col("conv"), F.col("turn"), F.col("role"), F.md5(F.coalesce("text", F.lit("")))]
    placed = numbered(rows, order, space, "ordered")
    starts = placed.groupBy(F.col("conv").alias("c")).agg(F.min("_pos").alias("_start"))
    placed = placed.join(starts, F.col("conv").eqNullSafe(F.col("c"))).drop("c")
    lines = placed.withColumn("lines", quote_lines(F.col("text")))
    messages = space.keep(lines.select(
        "_pos", "_start", "conv", "turn", "role", body_of(F.col("lines")).alias("body"),
        passages_of(F.col("lines")).alias("passages"),
    ), "messages")

    # a conversation's start names it: it is never null
    quotes = messages.filter(F.size("passages") > 0).select("_pos", "_start", F.posexplode("passages").alias("passage", "q"))
    quotes = quotes.select("_pos", "_start", "passage", "q.level", F.explode(units_of(F.col("q.text"))).alias("unit"))
    quotes = quotes.select("_pos", "_start", "passage", "level", F.length("unit").alias("size"), F.md5("unit").alias("hash"))
    quoting = quotes.select("_start").distinct()
    bodies = messages.join(quoting, "_start", "left_semi").select("_pos", "_start", F.explode(units_of(F.col("body"))).alias("unit"))
    firsts = bodies.groupBy("_start", F.md5("unit").alias("hash")).agg(F.min("_pos").alias("original"))
    met = quotes.join(firsts, ["_start", "hash"]).filter("original < _pos")
    by_original = met.groupBy("_pos", "passage", "level", "original").agg(F.sum("size").alias("size"))
    linked = by_original.groupBy("_pos", "passage", "level").agg(F.max(F.struct("size", "original")).alias("best"))
    replies = linked.groupBy("_pos").agg(
        F.count("*").alias("n_linked"), F.max(F.when(F.col("level") == 1, F.col("best"))).alias("best")
    )
    position = F.col("_pos") - F.col("_start")
    parent = F.coalesce(F.col("best.original") - F.col("_start"), F.when(position > 0, position - 1))
    chat = F.concat(
        F.lit(OPEN), escaped(F.coalesce(F.col("role").cast("string"), F.lit(""))), F.lit("\n"), escaped(F.col("body")), F.lit(f"{CLOSE}\n")
    )
    return messages.join(replies, "_pos", "left").select(
        F.col("conv").alias(conversation), F.col("turn").alias(turn), F.col("role").alias(role),
        position.alias("position"), parent.alias("reply_to"), F.size("passages").cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "body", chat.alias("chat"),
    )
