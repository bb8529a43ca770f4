"""Quotation linking in conversations, in DataFrame functions only.

Lines that begin with `>` are quoted, one level for each mark. Lines in a row of one level, up to a blank one, are a passage, however it is
wrapped. A passage gives units: itself, its sentences and its lines, normalised and hashed. A quoted passage is linked to the latest earlier
message of its conversation that says the longest of its units; the message that most passages of the outermost linked level come from is the
one it answers. Conversations come back in reply order, without the quotes.

A conversation may hold any share of the rows: what follows turns works on blocks of BLOCK turn numbers, and carries over what a block needs
of earlier ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edittide.llm.common import cut, in_order

#: Turn numbers of a block.
BLOCK = 4096

_MARKS = r"^[ \t]*>[> \t]*"
_QUOTED = r"(?:^|\n)[ \t]*>"
_WHITE = " \t\r\n"


def _normal(text: Column) -> Column:
    """Lower case, without punctuation, white space as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _lines(text: Column) -> Column:
    return F.split(text, r"\r?\n")


def _runs(text: Column) -> Column:
    """Array of the runs of lines of one level, each as level and lines between marks.

    Levels stand at both ends of a line, so that lines of one level in a row are joined by one replacement. Blank lines have no level.
    """

    def framed(line: Column) -> Column:
        marks = F.regexp_extract(line, _MARKS, 0)
        body = F.substring(line, F.length(marks) + 1, F.length(line))
        level = F.when(F.trim(body, F.lit(_WHITE)) == "", F.lit("b")).otherwise(F.length(F.regexp_replace(marks, "[^>]+", "")).cast("string"))
        return F.concat(F.lit("\x01"), level, F.lit("\x02"), body, F.lit("\x03"), level, F.lit("\x04"))

    clean = F.translate(text, "\x01\x02\x03\x04", "    ")
    joined = F.regexp_replace(F.array_join(F.transform(_lines(clean), framed), ""), "\x03(\\w+)\x04\x01\\1\x02", "\n")
    return F.split(joined, "(?<=\x04)(?=\x01)")


def passages(messages: DataFrame) -> DataFrame:
    """Passages: conv_id, turn, passage (number in the message), level (0: the message's own), body (its lines)."""
    rows = messages.filter("text is not null").select("conv_id", "turn", F.posexplode(_runs(F.col("text"))).alias("passage", "p"))
    level = F.substring_index(F.substring("p", 2, 20), "\x02", 1)
    rows = rows.select("conv_id", "turn", "passage", level.alias("level"), F.substring_index(F.substring_index("p", "\x02", -1), "\x03", 1).alias("body"))
    return rows.filter(F.rlike("level", F.lit("^[0-9]+$"))).withColumn("level", F.col("level").cast("int"))


def units(passages: DataFrame) -> DataFrame:
    """conv_id, turn, passage, level, key (hash), size (characters) of the units of each passage that have words."""
    flat = F.replace("body", F.lit("\n"), F.lit(" "))
    parts = F.concat(F.array("body"), F.split("body", "\n"), F.split(flat, r"(?<=[.!?…])\s"))
    each = passages.select("conv_id", "turn", "passage", "level", F.explode(F.array_distinct(F.transform(parts, _normal))).alias("n")).filter("n <> ''")
    return each.select("conv_id", "turn", "passage", "level", F.xxhash64("n").alias("key"), F.length("n").alias("size"))


def _block() -> Column:
    return F.floor(F.col("turn") / BLOCK).alias("block")


def linked(messages: DataFrame) -> DataFrame:
    """Per quoted passage that an earlier message says: conv_id, turn, passage, level, source (turn of the latest such message).

    An as-of join without pairs: the latest earlier turn that says a unit comes from its block, else from the latest earlier block that has one.
    Only conversations that quote, and of what they say only units that are quoted, take part.
    """
    quoting = messages.filter(F.rlike("text", F.lit(_QUOTED))).select("conv_id").distinct()
    found = units(passages(messages.join(quoting, "conv_id", "left_semi")))
    quoted = found.filter("level > 0")
    said = found.filter("level = 0").select("conv_id", "key", "turn").distinct().join(quoted.select("conv_id", "key").distinct(), ["conv_id", "key"], "left_semi")
    number = F.lit(None).cast("int")
    rows = said.select("conv_id", "key", "turn", F.col("turn").alias("at"), number.alias("passage"), number.alias("level"), number.alias("size")).unionByName(
        quoted.select("conv_id", "key", "turn", F.lit(None).cast(said.schema["turn"].dataType).alias("at"), "passage", "level", "size")
    )
    rows = rows.withColumn("block", _block())
    earlier = Window.partitionBy("conv_id", "key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("conv_id", "key", "block").agg(F.max("at").alias("m")).withColumn("carried", F.max("m").over(earlier)).drop("m")
    inside = Window.partitionBy("conv_id", "key", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("near", F.max("at").over(inside)).filter("level is not null").join(carried, ["conv_id", "key", "block"])
    hits = rows.withColumn("source", F.coalesce("near", "carried")).filter("source is not null")
    best = F.max(F.struct("size", "source"))["source"].alias("source")
    return hits.groupBy("conv_id", "turn", "passage", "level").agg(best)


def _numbered(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """`df`, whose keys and turn are unique, with the number of each row by turn among those of its keys, from 1."""
    rows = df.withColumn("block", _block())
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = rows.groupBy(*keys, "block").agg(F.count("*").alias("c")).withColumn("ahead", F.coalesce(F.sum("c").over(earlier), F.lit(0))).drop("c")
    inside = F.row_number().over(Window.partitionBy(*keys, "block").orderBy("turn"))
    return rows.withColumn(name, inside).join(ahead, [*keys, "block"]).withColumn(name, (F.col(name) + F.col("ahead")).cast("long")).drop("ahead", "block")


def _replies(turns: DataFrame, best: DataFrame) -> DataFrame:
    """conv_id, turn, before (the turn before it), reply_to, run (the turn that opens its run of turns which each answer the one before), open
    (the next turn does not answer it)."""
    conv, cell = Window.partitionBy("conv_id").orderBy("block"), Window.partitionBy("conv_id", "block").orderBy("turn")
    rows = turns.withColumn("block", _block())
    ends = rows.groupBy("conv_id", "block").agg(F.max("turn").alias("last")).withColumn("carried", F.lag("last").over(conv)).drop("last")
    rows = rows.withColumn("near", F.lag("turn").over(cell)).join(ends, ["conv_id", "block"]).withColumn("before", F.coalesce("near", "carried")).drop("near", "carried")
    rows = rows.join(best, ["conv_id", "turn"], "left").withColumn("reply_to", F.coalesce("parent", "before"))
    rows = rows.withColumn("head", F.col("before").isNull() | (F.col("reply_to") != F.col("before")))
    heads = F.max(F.when(F.col("head"), F.col("turn")))
    edges = rows.groupBy("conv_id", "block").agg(F.min_by("head", "turn").alias("first"), heads.alias("last"))
    edges = edges.select("conv_id", "block", F.lead("first").over(conv).alias("follows"), F.max("last").over(conv.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    rows = rows.withColumns({"near": heads.over(cell), "next": F.lead("head").over(cell)}).join(edges, ["conv_id", "block"])
    return rows.select("conv_id", "turn", "before", "reply_to", F.coalesce("near", "carried").alias("run"), F.coalesce("next", "follows", F.lit(True)).alias("open"), "n_linked")


def _tops(placed: DataFrame) -> DataFrame | None:
    """Per run that continues an earlier run: conv_id, run, up (the run that opens the thread); None if none does.

    A run continues the one whose last message it answers, if it is the first to. Pointers are doubled, so steps grow with the logarithm of the
    runs of a thread.
    """
    heads = placed.filter("reply_to <> before").select("conv_id", "run", "turn", F.col("reply_to").alias("parent"))
    first = heads.groupBy("conv_id", "parent").agg(F.min_by("run", "turn").alias("run"))
    ups = cut(first.join(placed.filter("open").select("conv_id", F.col("turn").alias("parent"), F.col("run").alias("up")), ["conv_id", "parent"]).select("conv_id", "run", "up"))
    if ups.isEmpty():
        return None
    while True:
        further = ups.select("conv_id", F.col("run").alias("up"), F.col("up").alias("further"))
        step = cut(ups.join(further, ["conv_id", "up"], "left"))
        ups = step.select("conv_id", "run", F.coalesce("further", "up").alias("up"))
        if step.filter("further is not null").isEmpty():
            return ups


def _ranks(placed: DataFrame) -> DataFrame | None:
    """Per thread of a conversation of several: conv_id, top, thread (its number, depth first); None if all have one.

    A thread hangs on the message that its first one answers. After the messages of a thread come those that hang on it, the later the message they
    hang on the earlier, those of one message by turn. So a thread's place is the path of (- position of the message, opening turn) from the
    root; paths are joined by doubling pointers, and the threads are range-sorted by them.
    """
    opens = placed.filter("turn = top and reply_to is not null").select("conv_id", "top", "reply_to")
    at = placed.select("conv_id", F.col("turn").alias("reply_to"), F.col("top").alias("up"), "position")
    step = F.struct((-F.col("position")).alias("q"), F.col("top").alias("t"))
    paths = cut(opens.join(at, ["conv_id", "reply_to"]).select("conv_id", "top", "up", F.array(step).alias("path")))
    if paths.isEmpty():
        return None
    while True:
        above = paths.select("conv_id", F.col("top").alias("up"), F.col("up").alias("further"), F.col("path").alias("start"))
        paths = cut(paths.join(above, ["conv_id", "up"], "left").select("conv_id", "top", F.col("further").alias("up"), F.when(F.col("start").isNull(), F.col("path")).otherwise(F.concat("start", "path")).alias("path")))
        if paths.filter("up is not null").isEmpty():
            break
    placed = in_order(paths.select("conv_id", "top", "path"), [F.asc("conv_id"), F.asc("path")], {"n": F.lit(1)})
    least = placed.groupBy("conv_id").agg(F.min("n").alias("least"))
    return placed.join(least, "conv_id").select("conv_id", "top", (F.col("n") - F.col("least") + 2).alias("thread"))


def threads(messages: DataFrame) -> DataFrame:
    """Per row of `messages` (conv_id, turn, role, text): conv_id, turn, role, text, reply_to, thread, position, n_quoted, n_linked.

    text: without quoted lines (null stays null). n_quoted, n_linked: quoted passages, and those that an earlier message says. reply_to: the turn
    that most passages of the outermost linked level come from, the latest of equals; without links the turn before, null for the first.
    The first reply to a message continues its thread, each further one opens a thread; position counts in a thread. By thread and position a
    conversation is in reply order: each message before its replies, depth first, replies of one message by turn. Turns that
    repeat are one message for links; rows without conv_id or turn link with nothing, and have no reply_to, thread 0 and position 0.
    """
    known = messages.filter("conv_id is not null and turn is not null").select("conv_id", "turn", F.col("text").cast("string").alias("text"))
    votes = linked(known).groupBy("conv_id", "turn", "level", "source").agg(F.count("*").alias("c"))
    best = votes.groupBy("conv_id", "turn").agg(F.min(F.struct("level", -F.col("c"), -F.col("source"))).alias("b"), F.sum("c").alias("n_linked"))
    best = best.select("conv_id", "turn", (-F.col("b")["col3"]).alias("parent"), "n_linked")
    placed = cut(_replies(known.select("conv_id", "turn").distinct(), best))
    tops = _tops(placed)
    placed = placed.withColumn("top", F.col("run")) if tops is None else placed.join(tops, ["conv_id", "run"], "left").withColumn("top", F.coalesce("up", "run")).drop("up")
    placed = cut(_numbered(placed, ["conv_id", "top"], "position"))
    ranks = _ranks(placed)
    one = F.lit(1).cast("long")
    placed = placed.withColumn("thread", one) if ranks is None else placed.join(ranks, ["conv_id", "top"], "left").withColumn("thread", F.coalesce("thread", one))
    placed = placed.select("conv_id", "turn", "reply_to", "n_linked", "thread", "position")
    text = F.col("text").cast("string")
    any_ = F.coalesce(F.rlike(text, F.lit(_QUOTED)), F.lit(False))
    own = F.trim(F.array_join(F.filter(_lines(text), lambda x: ~F.rlike(x, F.lit(_MARKS))), "\n"), F.lit(_WHITE))
    counted = F.size(F.filter(_runs(text), lambda x: F.rlike(x, F.lit("^\x01[1-9]"))))
    plain = messages.select("conv_id", "turn", "role", F.when(any_, own).otherwise(text).alias("text"), F.when(any_, counted).otherwise(0).cast("long").alias("n_quoted"))
    out = plain.join(placed, ["conv_id", "turn"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", "turn", "role", "text", "reply_to", zero("thread"), zero("position"), "n_quoted", zero("n_linked")).orderBy("conv_id", "thread", "position")
