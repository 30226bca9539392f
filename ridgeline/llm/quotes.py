"""Quotation linking: from messages with quoted parts to reply-ordered conversations.

Lines are parsed into quote levels (the number of leading ``>``); neighbouring lines of one
level are a passage. Passages are known by a hash of their normalised text (lower case,
white-space runs as one space). A quoted passage belongs to the earliest message, of all
messages, whose own passage has that hash. Where several do, these come first, in this order:
messages of the same thread that themselves quote, one level lower and just before, what stands
just before the quotation; others of the same thread; others that quote the same. A passage that
is no whole passage of an earlier message is looked up line by line in the same way (without
the part about quotations), and the message that most of its lines come from is taken. The
parent of a message is the source of its first linked passage of the lowest level; following
parents gives the root and the depth.

Texts are parsed inside their rows. Then only hashes and numbers travel: messages are reduced to
the earliest one per hash before they meet the quotations, whose hot hashes are spread, and texts
are joined once to the finished links. Everything is a DataFrame expression.

Defined cases: null and blank texts have no passages and an empty own text; rows equal in
thread, message number, role and text are one message, and rows that differ in any of them are
messages of their own; a message number is a time, so only a smaller one is earlier, in any
thread; a null thread is an unknown one; rows without a number stay, a row each, without links;
quotations of nothing known stay unlinked and are left out of the text all the same; an empty
table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.operators import skew
from ridgeline.workdir import delete_dir, new_run_dir, write_table

#: Messages, about, that one task puts in order within a conversation; most ranges of a conversation.
PLACE_ROWS = 1 << 20
PLACE_RANGES = 1000


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def _key(text: Column) -> Column:
    """Hash of the normalised text, null if it is blank."""
    return _let(normalised(text), lambda found: F.when(found != "", F.md5(found)))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once for all its uses."""
    return F.get(F.transform(F.array(value), use), 0)


def passages(text: Column) -> Column:
    """array<struct<passage, level, lines>> of a text, in order."""

    def parsed(raw: Column) -> Column:
        return _let(
            F.regexp_extract(raw, r"^((?:\s?>)*)", 1),
            lambda mark: F.struct(
                (F.length(mark) - F.length(F.replace(mark, F.lit(">"), F.lit("")))).alias("level"),
                F.when(F.length(mark) > 0, F.ltrim(F.substring(raw, F.length(mark) + 1, F.length(raw)))).otherwise(raw).alias("body"),
            ),
        )

    def grouped(levels: Column, bodies: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(levels) - 1)
        starts = F.filter(places, lambda i: (i == 0) | (F.get(levels, i) != F.get(levels, i - 1)))
        return _let(
            starts,
            lambda at: F.transform(
                at,
                lambda start, number: F.struct(
                    number.alias("passage"),
                    F.get(levels, start).alias("level"),
                    F.slice(bodies, start + 1, F.coalesce(F.get(at, number + 1), F.size(levels)) - start).alias("lines"),
                ),
            ),
        )

    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), parsed)
    return _let(
        lines,
        lambda found: _let(
            found.getField("level"), lambda levels: _let(found.getField("body"), lambda bodies: grouped(levels, bodies))
        ),
    )


def _keyed(found: Column) -> Column:
    """Passages that are not blank, with their hash and that of what they answer.

    That is the passage just before, if it is one level lower (quoted once more).
    """
    keyed = F.transform(
        found,
        lambda p: F.struct(
            p.getField("passage").alias("passage"),
            p.getField("level").alias("level"),
            _key(F.array_join(p.getField("lines"), "\n")).alias("key"),
            F.filter(F.transform(p.getField("lines"), _key), F.isnotnull).alias("lines"),
        ),
    )

    def with_answered(all_of: Column) -> Column:
        return F.transform(
            all_of,
            lambda p, i: _let(
                F.get(all_of, i - 1),
                lambda before: F.struct(
                    p.getField("passage").alias("passage"),
                    p.getField("level").alias("level"),
                    p.getField("key").alias("key"),
                    F.when(before.getField("level") == p.getField("level") + 1, before.getField("key")).alias("answered"),
                    p.getField("lines").alias("lines"),
                ),
            ),
        )

    return _let(F.filter(keyed, lambda p: p.getField("key").isNotNull()), with_answered)


def _parsed(messages: DataFrame) -> DataFrame:
    """A number per row, the message's own text, and its own and quoted passages as hashes."""
    rows = messages.select(
        F.monotonically_increasing_id().alias("node"),
        "thread",
        F.col("message").cast("long").alias("message"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.withColumn("print", F.unhex(F.md5(F.concat_ws("\0", "role", "text"))))
    found = rows.withColumn("found", passages(F.col("text"))).drop("text")
    own = F.transform(
        F.filter("found", lambda p: p.getField("level") == 0), lambda p: F.array_join(p.getField("lines"), "\n")
    )
    keyed = found.withColumn("own", F.regexp_replace(F.array_join(own, "\n"), r"^\n+|\n+$", "")).withColumn(
        "found", _keyed(F.col("found"))
    )
    return keyed.select(
        "node", "thread", "message", "print", "role", "own",
        F.filter("found", lambda p: p.getField("level") == 0).alias("said"),
        F.filter("found", lambda p: p.getField("level") > 0).alias("quoted"),
    )


def _looked_up(*parts: Column) -> Column:
    """One hash of several, null if one of them is."""
    return F.unhex(F.md5(F.concat(*[F.concat(F.lit(" "), p) for p in parts])))


def _passage_keys() -> Column:
    """What a passage is looked up by, the best first."""
    thread, key, answered = F.md5(F.col("thread").cast("string")), F.col("p.key"), F.col("p.answered")
    return F.array(
        _looked_up(F.lit("tqa"), thread, key, answered),
        _looked_up(F.lit("tq"), thread, key),
        _looked_up(F.lit("qa"), key, answered),
        _looked_up(F.lit("q"), key),
    )


def _line_keys() -> Column:
    thread = F.md5(F.col("thread").cast("string"))
    return F.array(_looked_up(F.lit("tl"), thread, F.col("line")), _looked_up(F.lit("l"), F.col("line")))


def _ranked(rows: DataFrame, keys: Column) -> DataFrame:
    """A row for each key that a row has, with the key's rank."""
    columns = [c for c in rows.columns if c not in ("p", "line")]
    return rows.select(*columns, F.posexplode(keys).alias("rank", "key")).where("key is not null")


def _earliest(originals: DataFrame) -> DataFrame:
    """The earliest message per key."""
    source = F.struct("message", "thread", "print", "node")
    return originals.groupBy("key").agg(F.min(source).alias("source"))


def _met(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Written ``rows`` with the one row of ``found`` of their key; hot keys are spread."""
    hot = skew.find_hot(rows, key)[0] if rows.count() > skew.DEFAULT_HOT_ROWS else None
    if hot is None:
        return rows.join(found, key, "left")
    left, right = skew.spread(rows, hot, key, "node", "part"), skew.replicate(found, hot, key, "part")
    return left.join(right, [key, "part"], "left").drop("part")


def _sources(originals: DataFrame, quotations: DataFrame, place: list[str], folders: list[str]) -> DataFrame:
    """The source, or null, of each place in the quotations (place, node, message, rank, key)."""
    spark = quotations.sparkSession
    folders.append(new_run_dir(spark, "quotations"))
    quotations = write_table(quotations, folders[-1])
    met = _met(quotations, _earliest(originals), "key")
    best = F.min(F.when(F.col("source.message") < F.col("message"), F.struct("rank", "source")))
    return met.groupBy("node", *place).agg(best["source"].alias("source"))


def _linked(parsed: DataFrame, folders: list[str]) -> DataFrame:
    """(node, passage, level, source) of all quoted passages."""
    spark = parsed.sparkSession
    numbered = parsed.where("message is not null")
    said = numbered.select("node", "thread", "message", "print", F.explode("said").alias("p"))
    quoted = numbered.select("node", "thread", "message", F.explode("quoted").alias("p"))
    placed = quoted.select("node", "thread", "message", F.col("p.passage").alias("passage"), F.col("p.level").alias("level"), "p")
    whole = _sources(_ranked(said, _passage_keys()), _ranked(placed, _passage_keys()).drop("thread"), ["passage", "level"], folders)
    folders.append(new_run_dir(spark, "linked-passages"))
    whole = write_table(whole, folders[-1])
    rest = whole.where("source is null").select("node", "passage")
    if rest.isEmpty():
        return whole
    said_lines = said.select("node", "thread", "message", "print", F.explode("p.lines").alias("line"))
    lines = quoted.select("node", "thread", "message", F.col("p.passage").alias("passage"), F.posexplode("p.lines").alias("at", "line"))
    lines = _ranked(lines.join(rest, ["node", "passage"], "left_semi"), _line_keys()).drop("thread")
    votes = _sources(_ranked(said_lines, _line_keys()), lines, ["passage", "at"], folders).where("source is not null")
    votes = votes.groupBy("node", "passage", "source").agg(F.count("*").alias("votes"))
    chosen = votes.groupBy("node", "passage").agg(F.min(F.struct(-F.col("votes"), "source"))["source"].alias("by_line"))
    return whole.join(chosen, ["node", "passage"], "left").select(
        "node", "passage", "level", F.coalesce("source", "by_line").alias("source")
    )


def _roots(links: DataFrame, folders: list[str]) -> DataFrame:
    """Root and depth of every message with a parent, by doubling the distance looked ahead.

    A message is done when it points to one without a parent; only the others are joined again.
    """
    spark = links.sparkSession
    current = links.where("parent is not null").select(
        "node", F.col("parent").alias("root"), F.lit(1).alias("depth"), F.lit(False).alias("done")
    )
    while True:
        folders.append(new_run_dir(spark, "reply-roots"))
        current = write_table(current, folders[-1])
        if current.where("not done").isEmpty():
            return current.drop("done")
        ahead = current.select(
            F.col("node").alias("at"), F.col("root").alias("next"), F.col("depth").alias("more"), F.col("done").alias("next_done")
        )
        moved = _met(current.where("not done").withColumnRenamed("root", "at").drop("done"), ahead, "at").select(
            "node",
            F.coalesce("next", "at").alias("root"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            F.coalesce("next_done", F.lit(True)).alias("done"),
        )
        current = current.where("done").unionByName(moved)


def _placed(rows: DataFrame) -> DataFrame:
    """``place`` of each message among those of its root, by number; ranges of one root are
    counted first, so that a long conversation is put in order by several tasks."""
    n = rows.count()
    ranges = min(PLACE_RANGES, math.ceil(n / PLACE_ROWS))
    order = ["message", "thread", "print", "node"]
    if ranges <= 1:
        return rows.withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy(*order)))
    cuts = rows.agg(F.percentile_approx("message", [i / ranges for i in range(1, ranges)])).first()[0] or []
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts))])
    ranged = rows.withColumn("range", F.size(F.filter(bounds, lambda c: c < F.col("message"))))
    counts = ranged.groupBy("root", "range").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("root").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("root", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = ranged.withColumn("inside", F.row_number().over(Window.partitionBy("root", "range").orderBy(*order)))
    placed = inside.join(before, ["root", "range"])
    return placed.withColumn("place", (F.col("inside") + F.col("before")).cast("int")).drop("range", "inside", "before")


def conversations(messages: DataFrame) -> DataFrame:
    """Per message (thread, message, role, text): its parent, root, depth, place and own text.

    Parents and roots are given by thread and message number. ``place`` counts the messages of
    one root in an order in which parents precede replies.
    """
    spark = messages.sparkSession
    folders: list[str] = []
    parsed = write_table(_parsed(messages), new_run_dir(spark, "parsed-messages"))
    links = _linked(parsed, folders).groupBy("node").agg(
        F.count("*").alias("n_quotes"),
        F.count("source").alias("n_linked"),
        F.min(F.when(F.col("source").isNotNull(), F.struct("level", "passage", "source")))["source"].alias("found"),
    )
    links = links.select(
        "node", "n_quotes", "n_linked", F.col("found.node").alias("parent"),
        F.col("found.thread").alias("parent_thread"), F.col("found.message").alias("parent_message"),
    )
    folders.append(new_run_dir(spark, "linked-messages"))
    links = write_table(links, folders[-1])
    roots = _roots(links, folders)
    narrow = parsed.select("node", "thread", "message", "print")
    numbered = narrow.where("message is not null").groupBy("thread", "message", "print").agg(F.min("node").alias("node"))
    kept = numbered.unionByName(narrow.where("message is null"))
    kept = kept.join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    folders.append(new_run_dir(spark, "rooted-messages"))
    kept = write_table(kept, folders[-1])
    heads = kept.where("root = node").select(
        F.col("node").alias("root"), F.col("thread").alias("root_thread"), F.col("message").alias("root_message")
    )
    headed = write_table(_met(_placed(kept), heads, "root"), new_run_dir(spark, "conversations"))
    for folder in folders:
        delete_dir(spark, folder)
    return headed.select(
        "node", "parent_thread", "parent_message", "root_thread", "root_message", "depth", "place", "n_quotes", "n_linked"
    ).join(parsed, "node").select(
        "thread",
        "message",
        "role",
        "parent_thread",
        F.col("parent_message").alias("parent"),
        "root_thread",
        F.col("root_message").alias("root"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
        "place",
        F.col("own").alias("text"),
        F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
    )


def with_quotations(turns: DataFrame) -> DataFrame:
    """Messages as a mail program sends them: each turn of a conversation quotes the one before
    at level 1 and the one before that at level 2, above its own text.

    ``turns`` has (conv_id, turn, role, text). The messages have no thread; their numbers go by
    turn first, as if all conversations were held at one time (conv_id below two to the 32nd).
    """
    base = turns.select("conv_id", "turn", "role", "text")
    later = base.select("conv_id", "turn", "text", F.explode(F.array(F.lit(1), F.lit(2))).alias("off"))
    quoted = later.groupBy("conv_id", (F.col("turn") + F.col("off")).alias("turn")).agg(
        F.max(F.when(F.col("off") == 1, F.col("text"))).alias("one"),
        F.max(F.when(F.col("off") == 2, F.col("text"))).alias("two"),
    )
    quote = lambda c, mark: F.regexp_replace(c, r"(?m)^", mark)
    return base.join(quoted, ["conv_id", "turn"], "left").select(
        F.lit(None).cast("long").alias("thread"),
        (F.shiftleft(F.col("turn").cast("long"), 32) + F.col("conv_id")).alias("message"),
        "role",
        F.concat_ws("\n", quote("two", "> > "), quote("one", "> "), "text").alias("text"),
    )
