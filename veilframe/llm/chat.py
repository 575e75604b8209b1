"""Chat formatting with quotation linking, in DataFrame functions alone.

Quoted lines ("> ...", ">> ...") are parsed by level. Hashes of normalised quoted
passages are joined to hashes of what earlier messages of the conversation said
themselves; a match makes that message the parent. Messages come out without
their quotes, with their place in the order of replies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import checkpointed, name, written
from veilframe.llm.lists import indices, let, running_sum

# No group is repeated: Java's regex recurses for those, and a long quote would end the JVM.
QUOTE = r"^([ \t>]*>)[ \t]?"
QUOTED = r"(?:^|\n)[ \t]*>"
ATTRIBUTION = r"(?i)^(on .*|.*\S) (wrote|writes|schrieb|a écrit|escribió):[ \t]*$"
ENDS = r"\A\s+|(?<!\s)\s+\z"
QUOTES = "array<struct<level:int,whole:int,hash:binary>>"


def _level(line: Column) -> Column:
    return F.char_length(F.regexp_replace(F.regexp_extract(line, QUOTE, 1), "[^>]", ""))


def normalised(text: Column) -> Column:
    """Lower case, runs of white space as one space, no space at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _lines(text: Column) -> Column:
    """Array of (line, level)."""
    return F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), _level(x).alias("level")))


def own_text(lines: Column) -> Column:
    """The lines that quote nothing, without attribution lines right before a quote and blank ends."""
    after = F.concat(F.transform(F.slice(lines, F.lit(2), F.size(lines)), lambda c: c["level"]), F.array(F.lit(0)))
    cells = F.zip_with(lines, after, lambda c, n: F.struct(c["line"].alias("line"), c["level"].alias("level"), n.alias("next")))
    kept = F.filter(cells, lambda c: (c["level"] == 0) & ~((c["next"] > 0) & c["line"].rlike(ATTRIBUTION)))
    return F.regexp_replace(F.array_join(F.transform(kept, lambda c: c["line"]), "\n"), ENDS, "")


def quotes(lines: Column) -> Column:
    """Array of (level, whole, hash): the passages of each level of each quoted block, and their single lines.

    Lines of a block have as many unquoted lines before them. Sorted by block and
    level, the lines of a passage stand side by side; it begins where either changes.
    """
    block = running_sum(F.transform(lines, lambda c: (c["level"] == 0).cast("int")))
    cells = F.zip_with(lines, block, lambda c, b: F.struct(b.alias("block"), c["level"].alias("level"), c["line"].alias("line")))
    placed = F.transform(cells, lambda c, i: F.struct(c["block"].alias("block"), c["level"].alias("level"), i.alias("at"), F.regexp_replace(c["line"], QUOTE, "").alias("text")))
    ordered = F.array_sort(F.filter(placed, lambda c: c["level"] > 0))

    def first_of(cells: Column, i: Column) -> Column:
        now, before = F.get(cells, i), F.get(cells, i - 1)
        return (i == 0) | (now["block"] != before["block"]) | (now["level"] != before["level"])

    def passages(cells: Column, starts: Column) -> Column:
        ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(cells)))
        runs = F.zip_with(starts, ends, lambda a, b: F.slice(cells, a + 1, b - a))
        whole = F.transform(runs, lambda r: F.struct(F.get(r, F.lit(0))["level"].alias("level"), F.lit(1).alias("whole"), normalised(F.array_join(F.transform(r, lambda c: c["text"]), "\n")).alias("text")))
        return F.concat(whole, F.transform(cells, lambda c: F.struct(c["level"].alias("level"), F.lit(0).alias("whole"), normalised(c["text"]).alias("text"))))

    found = let(ordered, lambda cells: let(F.filter(indices(cells), lambda i: first_of(cells, i)), lambda starts: passages(cells, starts)))
    return F.transform(F.filter(found, lambda p: p["text"] != ""), lambda p: F.struct(p["level"].alias("level"), p["whole"].alias("whole"), _hash(p["text"]).alias("hash")))


def units(own: Column) -> Column:
    """Distinct hashes of what may be quoted of a text: all of it, its paragraphs, its lines."""
    parts = F.concat(F.array(own), F.split(own, r"\n[ \t]*\n"), F.split(own, "\n"))
    return F.transform(F.filter(F.array_distinct(F.transform(parts, normalised)), lambda t: t != ""), _hash)


def reply_links(plain: DataFrame, asking: DataFrame) -> DataFrame:
    """(conv, turn, parent): the earlier message each quoting message answers.

    ``plain`` and ``asking`` are the messages without and with quotes. A unit of
    text belongs to the first turn of the conversation that said it. Of several
    matches the lowest quote level counts, then whole passages before single
    lines, then the latest turn. Every quote meets at most one original. Only
    hashes are shuffled, those of originals after they are combined.
    """
    said = plain.select("conv", "turn", "own").unionByName(asking.select("conv", "turn", "own"))
    said = said.select("conv", "turn", F.explode(units(F.col("own"))).alias("hash"))
    first = said.groupBy("conv", "hash").agg(F.min("turn").alias("parent"))
    asked = asking.select("conv", "turn", F.explode("quotes").alias("q")).select("conv", "turn", "q.level", "q.whole", "q.hash").distinct()
    matched = asked.join(first, ["conv", "hash"]).where("parent < turn")
    best = F.max(F.struct((-F.col("level")).alias("near"), "whole", "parent"))
    return matched.groupBy("conv", "turn").agg(best.alias("b")).select("conv", "turn", F.col("b.parent").alias("parent"))


def _threads(links: DataFrame) -> DataFrame:
    """(conv, turn, parent, root, depth) by pointer doubling; rounds grow with the logarithm of the depth."""
    jump = checkpointed(links.select("conv", "turn", "parent", F.col("parent").alias("root"), F.lit(1).alias("depth")))
    while True:
        hop = jump.select("conv", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        moved = jump.join(hop, ["conv", "root"], "left")
        if moved.where("next is not null").isEmpty():
            return jump
        jump = checkpointed(moved.select("conv", "turn", "parent", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))


def format_chat(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """(conv_id, turn, role, content, formatted, parent_turn, root_turn, depth) of every message.

    Sorting by conv_id, root_turn, turn gives the conversations in the order of
    replies. ``parent_turn`` is null where nothing earlier was quoted; such a
    message is the root of its own thread at depth 0. ``formatted`` frames the
    content by its role.

    Null texts are empty, null roles are ``unknown``; messages without a
    conversation or turn are linked with nothing. Messages of equal conversation
    and turn are one node: they share a parent and keep their own texts. Texts of
    any length and depth of quotes are taken whole, in time nearly linear in
    their length. An empty table gives no rows; columns other than the four named
    are not read. Messages that quote nothing are never written or shuffled.
    """
    rows = conversations.select(
        name(conv_col).alias("conv"),
        name(turn_col).alias("turn"),
        F.coalesce(name(role_col).cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(name(text_col).cast("string"), F.lit("")).alias("text"),
    )
    quoting = F.col("text").rlike(QUOTED)
    apart = {"parent": F.lit(None).cast(rows.schema["turn"].dataType), "root": F.col("turn"), "depth": F.lit(0)}
    plain = rows.where(~quoting).withColumnRenamed("text", "own")
    parsed = let(_lines(F.col("text")), lambda lines: F.struct(own_text(lines).alias("own"), quotes(lines).cast(QUOTES).alias("quotes")))
    asking = written(rows.where(quoting).withColumn("p", parsed).select("conv", "turn", "role", "p.own", "p.quotes"), "chat")
    placed = asking.where("conv is not null and turn is not null")
    if placed.isEmpty():
        linked = asking.drop("quotes").withColumns(apart)
    else:
        links = reply_links(plain.where("conv is not null and turn is not null"), placed)
        linked = asking.drop("quotes").join(_threads(links), ["conv", "turn"], "left")
        linked = linked.withColumns({"root": F.coalesce("root", "turn"), "depth": F.coalesce("depth", F.lit(0))})
    return _formatted(linked.unionByName(plain.withColumns(apart)))


def _formatted(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("conv").alias("conv_id"),
        "turn",
        "role",
        F.col("own").alias("content"),
        F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("own"), F.lit("\n<|end|>\n")).alias("formatted"),
        F.col("parent").alias("parent_turn"),
        F.col("root").alias("root_turn"),
        "depth",
    )
