"""Chat formatting by quotation linking, with DataFrame functions only.

A message's lines are parsed for quote marks (``>``, nested ``> >``): a line's
level is the number of marks, its body what follows. Consecutive lines of one
level that are not blank are a passage. Passages are normalised over their line
breaks (A-Z lower-cased, everything but letters and digits one blank) and hashed,
whole, by sentence (cut after ``.``, ``!`` or ``?`` and a blank) and by line, so a
quote that was wrapped anew or shortened still meets its source. A quoted unit is
linked to the message in which it stands unquoted: the first such message of its
own conversation if that comes earlier, else, for units of ``min_words`` words or
more (a short "ok" is said anywhere), the first of all conversations if that
precedes it by (conv_id, turn). Firsts are aggregates, so a unit that very many
messages share is one row on the joined side and a quoted unit has one link at
most; links point backwards, so replies form trees.

A message replies to the message to which most words of the linked units of its
least linked level point (ties: the earliest). Its ``path`` lists the turns from the
root of its tree down to itself; ordering a thread's messages by ``path`` puts
every reply after what it answers. Paths are built by pointer doubling, so a
chain of n replies takes log n rounds.

Defined cases: a null text has no lines and stays null; a message with a null
conv_id or turn is kept, links to nothing and is linked by nothing; messages
that share (conv_id, turn) share their links; a unit that repeats in its passage
counts once; passages without letters or digits never link; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, small_side

#: The marks that open a quoted line.
MARKS = r"^(?:[ \t]*>)+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


#: Where a sentence ends; the marks themselves go.
SENTENCE_END = r"[.!?]+[ \t\n]+"
#: Words a unit needs to be linked outside its own conversation.
MIN_WORDS = 5


def _lines(text: Column) -> Column:
    """Lines of a text: level, body."""
    def parse(line: Column) -> Column:
        marks = F.regexp_extract(line, MARKS, 0)
        return F.struct(F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"),
                        F.substr(line, F.length(marks) + F.lit(1)).alias("body"))

    return F.transform(F.split(text, "\r?\n"), parse)


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_lower(text), NOT_WORD, " "))


def _passages(text: Column) -> Column:
    """Passages of a text, each as level, U+0002 and its lines; U+0001 before each."""
    def mark(lines: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            before = F.get(lines, i - 1)
            goes_on = (i > 0) & (before["level"] == x["level"]) & (F.trim(before["body"], F.lit(" \t")) != "") & (
                F.trim(x["body"], F.lit(" \t")) != "")
            body = F.translate(x["body"], "\x01\x02", "  ")
            return F.when(goes_on, F.concat(F.lit("\n"), body)).otherwise(
                F.concat(F.lit("\x01"), x["level"].cast("string"), F.lit("\x02"), body))

        return F.array_join(F.transform(lines, one), "")

    # an array of one, so that the lines are parsed once for all their neighbours
    return F.split(F.get(F.transform(F.array(_lines(text)), mark), F.lit(0)), "\x01")


def units(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, h, words): what each passage can be met by."""
    passages = messages.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select(
        "conv_id", "turn", F.explode(_passages(F.col("text"))).alias("x")).filter("x <> ''")
    passages = passages.select("conv_id", "turn", F.substring_index("x", "\x02", 1).cast("int").alias("level"),
                               F.substring_index("x", "\x02", -1).alias("p"))
    pieces = F.concat(F.array("p"), F.split("p", SENTENCE_END), F.split("p", "\n"))
    normal = F.array_distinct(F.transform(pieces, _normal))
    return (passages.select("conv_id", "turn", "level", F.explode(normal).alias("u")).filter("u <> ''")
            .select("conv_id", "turn", "level", F.md5(F.col("u").cast("binary")).alias("h"),
                    F.size(F.split("u", " ")).alias("words")))


def without_quotes(text: Column) -> Column:
    """The text's own lines; blank lines at both ends go."""
    own = F.array_join(F.transform(F.filter(_lines(text), lambda x: x["level"] == 0), lambda x: x["body"]), "\n")
    return F.when(text.isNotNull(), F.regexp_replace(own, r"^(?:[ \t]*\n)+|(?:\n[ \t]*)+$", ""))


def links(messages: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(conv_id, turn, level, h, words, n, to_conv, to_turn): each quoted unit's message."""
    lined = units(messages)
    quoted = materialize(lined.filter("level > 0").groupBy("conv_id", "turn", "level", "h", "words").agg(
        F.count(F.lit(1)).alias("n")), "quoted")
    wanted = small_side(materialize(quoted.select("h").distinct(), "quoted-hashes"))
    own = materialize(lined.filter("level = 0").join(wanted, "h", "left_semi").groupBy("conv_id", "h").agg(
        F.min("turn").alias("to_turn")), "own")
    here = own.withColumnRenamed("to_turn", "here")
    first = own.groupBy("h").agg(F.min(F.struct(F.col("conv_id").alias("c"), F.col("to_turn").alias("t"))).alias("any"))
    near = F.col("here").isNotNull() & (F.col("here") < F.col("turn"))
    earlier = (F.col("words") >= min_words) & (F.col("any") < F.struct(F.col("conv_id").alias("c"), F.col("turn").alias("t")))
    to = F.when(near, F.struct(F.col("conv_id").alias("c"), F.col("here").alias("t"))).when(earlier, F.col("any"))
    return (quoted.join(here, ["conv_id", "h"], "left").join(first, "h", "left").withColumn("to", to)
            .select("conv_id", "turn", "level", "h", "words", "n", F.col("to.c").alias("to_conv"), F.col("to.t").alias("to_turn")))


def replies(linked: DataFrame) -> DataFrame:
    """(conv_id, turn, to_conv, to_turn, n_linked): what each message answers."""
    per = linked.filter("to_conv IS NOT NULL").groupBy("conv_id", "turn", "level", "to_conv", "to_turn").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("words")).alias("weight"))
    return per.groupBy("conv_id", "turn").agg(F.min(F.struct(
        "level", (-F.col("weight")).alias("k"), "to_conv", "to_turn")).alias("b"), F.sum("n").alias("n_linked")).select(
        "conv_id", "turn", "b.to_conv", "b.to_turn", "n_linked")


def paths(reply: DataFrame) -> DataFrame:
    """(conv_id, turn, root_conv, root_turn, path) of every message that answers one.

    ``path`` has (conv_id, turn) from the root to the message itself.
    """
    me = F.struct(F.col("conv_id").alias("c"), F.col("turn").alias("t"))
    up = F.struct(F.col("to_conv").alias("c"), F.col("to_turn").alias("t"))
    now = materialize(reply.select("conv_id", "turn", up.alias("up"), F.array(up, me).alias("path")), "paths")
    while True:
        above = now.select(F.struct(F.col("conv_id").alias("c"), F.col("turn").alias("t")).alias("up"),
                           F.col("up").alias("_up"), F.col("path").alias("_path"))
        new = materialize(now.join(above, "up", "left").select(
            "conv_id", "turn", F.coalesce("_up", "up").alias("up"), F.when(F.col("_path").isNull(), F.col("path")).otherwise(
                F.concat("_path", F.slice(F.col("path"), F.lit(2), F.size("path")))).alias("path"),
            F.col("_up").isNotNull().alias("moved")), "paths")
        now = new.drop("moved")
        if new.filter("moved").isEmpty():
            return now.select("conv_id", "turn", F.col("up.c").alias("root_conv"), F.col("up.t").alias("root_turn"), "path")


def format_chats(messages: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """conv_id, turn, role, text (own lines), n_quoted (lines), max_level, n_linked
    (units), reply_conv, reply_turn, thread_conv, thread_turn, path."""
    messages = messages.select("conv_id", "turn", "role", "text")
    reply = materialize(replies(links(messages, min_words)), "replies")
    known = small_side(materialize(reply.join(paths(reply), ["conv_id", "turn"]).select(
        F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), "n_linked", F.col("to_conv").alias("reply_conv"),
        F.col("to_turn").alias("reply_turn"), "root_conv", "root_turn",
        F.array_join(F.transform("path", lambda x: F.concat_ws(":", x["c"].cast("string"), x["t"].cast("string"))), "/").alias("path")),
        "known"))
    quoted = F.filter(_lines(F.col("text")), lambda x: x["level"] > 0)
    return (messages.join(known, (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t")), "left").select(
        "conv_id", "turn", "role", without_quotes(F.col("text")).alias("text"),
        F.coalesce(F.size(F.when(F.col("text").isNotNull(), quoted)), F.lit(0)).cast("long").alias("n_quoted"),
        F.coalesce(F.array_max(F.transform(quoted, lambda x: x["level"])), F.lit(0)).cast("long").alias("max_level"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "reply_conv", "reply_turn",
        F.coalesce("root_conv", "conv_id").alias("thread_conv"), F.coalesce("root_turn", "turn").alias("thread_turn"),
        F.coalesce("path", F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))).alias("path")))
