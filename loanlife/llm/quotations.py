"""Quotation linking: nested quotes to original messages, and conversations in reply order.

A line's level is the number of quote marks (``>``, a blank may follow each) before it; consecutive
lines of one level are a passage. Passages of level 0 are the message's own text, less the line that
introduces a quote (it ends in ``wrote:``). Quoted passages are normalised (A-Z lower-cased, white
space collapsed), hashed, and joined to the first message of the conversation whose own text, or else
one of whose own lines, has that hash; passages found in no earlier message of the conversation are
looked for in all conversations, as whole texts: in the first one, or, where that is the quoting
conversation itself, in the last one. Joins meet one row per hash, so a passage quoted or
written very often is merged before, and split in, the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlife.support import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), r"[\t\n\x0B\f\r ]+", " "))


def parse(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, message, own, passages)`` of ``messages(conv_id, turn, text)``.

    ``own`` is the text without quotes; ``passages`` are the quoted ones in order,
    ``array<struct<level, body>>``; ``message`` tells rows apart that repeat a key.
    """
    lines = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lines = lines.withColumn("message", F.md5("text")).withColumn("lines", F.transform(
        F.split("text", "\n", -1), lambda line: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(line, r"^(?:> ?)+", 0), "[^>]", ""))
            .alias("level"),
            F.regexp_replace(line, r"^(?:> ?)+", "").alias("body"))))
    n = F.size("lines")
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (
        F.element_at("lines", i)["level"]
        != F.element_at("lines", F.greatest(i - 1, F.lit(1)))["level"]))
    runs = lines.withColumn("starts", starts).withColumn(
        "ends", F.concat(F.expr("slice(starts, 2, size(starts))"), F.array(n + 1)))
    runs = runs.withColumn("runs", F.transform(F.arrays_zip("starts", "ends"), lambda p: F.struct(
        F.element_at("lines", p["starts"])["level"].alias("level"),
        (p["ends"] <= n).alias("followed"),
        F.array_join(F.transform(F.slice("lines", p["starts"], p["ends"] - p["starts"]),
                                 lambda x: x["body"]), "\n").alias("body"))))
    own = F.transform(F.filter("runs", lambda r: r["level"] == 0), lambda r: F.when(
        r["followed"], F.regexp_replace(r["body"], r"(^|\n)[^\n]*wrote:[ \t]*\n*$", ""))
        .otherwise(r["body"]))
    quoted = F.transform(F.filter("runs", lambda r: r["level"] > 0),
                         lambda r: F.struct(r["level"].alias("level"), r["body"].alias("body")))
    return runs.select("conv_id", "turn", "message",
                       F.array_join(F.filter(own, lambda x: x != ""), "\n").alias("own"),
                       quoted.alias("passages"))


def _keys(body: Column) -> Column:
    """Hashes of a passage and of its lines, the whole first; nothing for blank passages."""
    parts = F.concat(F.array(normalised(body)),
                     F.transform(F.split(body, "\n", -1), lambda x: normalised(x)))
    return F.array_distinct(F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.md5(x)))


def quote_links(parsed: DataFrame) -> DataFrame:
    """``(conv_id, turn, message, ordinal, level, to_conv, to_turn)`` of every quoted passage;
    passages found nowhere have nulls, blank ones no row."""
    own = parsed.select("conv_id", "turn", F.posexplode(_keys(F.col("own"))).alias("place", "key"))
    first = materialize(own.groupBy("conv_id", "key").agg(F.min("turn").alias("to_turn")), "own")
    everywhere = materialize(
        own.where("place = 0").where("conv_id is not null and turn is not null").groupBy("key").agg(
            F.min(F.struct("conv_id", "turn")).alias("origin"),
            F.max(F.struct("conv_id", (-F.col("turn")).alias("turn"))).alias("last")), "origins")
    quotes = parsed.select("conv_id", "turn", "message", F.posexplode("passages").alias("ordinal", "p"))
    quotes = materialize(quotes.select(
        "conv_id", "turn", "message", "ordinal", F.col("p.level").alias("level"),
        _keys(F.col("p.body")).alias("keys")).where("size(keys) > 0"), "quotes")
    which = ["conv_id", "turn", "message", "ordinal"]
    near = (quotes.select(*which, F.posexplode("keys").alias("place", "key"))
            .join(first, ["conv_id", "key"]).where("to_turn < turn")
            .groupBy(*which).agg(F.min(F.struct("place", "to_turn")).alias("best"))
            .select(*which, F.col("best.to_turn").alias("to_turn")))
    found = materialize(quotes.distinct().join(near, which, "left"), "found")
    far = (found.where("to_turn is null").withColumn("key", F.element_at("keys", 1))
           .join(everywhere, "key", "left")
           .withColumn("origin", F.coalesce(
               F.when(F.col("origin.conv_id") != F.col("conv_id"), F.col("origin")),
               F.when(F.col("last.conv_id") != F.col("conv_id"), F.struct(
                   F.col("last.conv_id"), (-F.col("last.turn")).alias("turn"))))))
    return (found.where("to_turn is not null")
            .select(*which, "level", F.col("conv_id").alias("to_conv"), "to_turn")
            .union(far.select(*which, "level", F.col("origin.conv_id"), F.col("origin.turn"))))


def threads(parents: DataFrame) -> DataFrame:
    """``(conv_id, turn, parent_turn, root_turn, depth)`` of ``parents(conv_id, turn,
    parent_turn)``, one row per message key.

    Every reply knows a message above it, first its parent. Each round, replies that do not know
    their thread's root yet take over what the message they know of knows, which doubles the
    distance; those that know it are not joined again.
    """
    key = ["conv_id", "root_turn"]
    replies = parents.where("parent_turn is not null").select(
        "conv_id", "turn", F.col("parent_turn").alias("root_turn"), F.lit(1).alias("depth"))
    above = replies.select("conv_id", F.col("turn").alias("root_turn"), F.lit(False).alias("ends"))
    known = materialize(replies.join(above, key, "left").select(
        "conv_id", "turn", "root_turn", "depth", F.coalesce("ends", F.lit(True)).alias("ends")),
        "threads")
    while True:
        open_ = known.where("not ends")
        if open_.isEmpty():
            break
        up = known.select("conv_id", F.col("turn").alias("root_turn"),
                          F.col("root_turn").alias("higher"), F.col("depth").alias("more"),
                          F.col("ends").alias("up_ends"))
        further = open_.join(up, key).select(
            "conv_id", "turn", F.col("higher").alias("root_turn"),
            (F.col("depth") + F.col("more")).alias("depth"), F.col("up_ends").alias("ends"))
        known = materialize(known.where("ends").union(further), "threads")
    return (parents.join(known.drop("ends"), ["conv_id", "turn"], "left")
            .select("conv_id", "turn", "parent_turn", F.coalesce("root_turn", "turn")
                    .alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth")))


def conversations(messages: DataFrame) -> DataFrame:
    """One row per row of ``messages(conv_id, turn, text)``, without quotes, in reply order:
    ``conv_id, root_turn, turn, parent_turn, depth, n_quotes, n_linked, body``.

    The parent is the latest message that a passage of the least level links to in the same
    conversation; ``root_turn`` is the first message of the thread. Sorted by conversation, root and
    turn, every message follows the one it answers. ``n_quotes`` counts quoted passages with text,
    ``n_linked`` those found here or in another conversation.

    Null texts are empty. A null conversation or turn is linked to nothing and its own root. Rows that
    repeat a key share their parent; equal rows stay as many as they are. Other columns are ignored.
    """
    parsed = materialize(parse(messages), "messages")
    links = materialize(quote_links(parsed), "links")
    key = ["conv_id", "turn"]
    here = links.where("to_conv = conv_id").select(*key, "level", "to_turn")
    least = here.groupBy(*key).agg(F.max(F.struct((-F.col("level")).alias("l"), "to_turn"))
                                   .alias("best"))
    keys = parsed.where("conv_id is not null and turn is not null").select(*key).distinct()
    tree = threads(keys.join(least.select(*key, F.col("best.to_turn").alias("parent_turn")), key,
                             "left"))
    counts = links.groupBy(*key, "message").agg(
        F.count("*").alias("n_quotes"), F.count("to_turn").alias("n_linked"))
    out = (parsed.drop("passages").join(tree, key, "left").join(counts, [*key, "message"], "left")
           .select("conv_id", F.coalesce("root_turn", "turn").alias("root_turn"), "turn",
                   "parent_turn", F.coalesce("depth", F.lit(0)).alias("depth"),
                   F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"),
                   F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.col("own").alias("body")))
    return out.orderBy("conv_id", "root_turn", "turn")
