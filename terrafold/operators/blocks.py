"""Nested blocks of marked lines in texts: each opener is paired with its closer by the level of nesting at which they stand.

A line that begins, white space aside, with three colons and a word goes one level down, one of three colons
alone one level up, wherever the text stands. An opener crosses the boundary between two levels; the next line
that crosses the same boundary can only go up again, so it is the opener's closer. That is one running sum and
one look ahead, each a window over the marked lines alone; lines without marks never leave their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.functions.text import trimmed

#: The kinds of blocks.
KINDS = ("details", "note", "warning")


def lines_of(text: Column) -> Column:
    return F.split(text, "\r?\n")


def block_pairs(marked: DataFrame, key: str, lines: str) -> DataFrame:
    """(key, opened, closed, line): of each text, once, the lines, from 0, that open and close a block, and the opening one.

    Only a line that begins with the mark and a kind known opens a block; any other marked line still counts as a level."""
    rows = marked.select(key, F.posexplode(lines).alias("at", "line"))
    told = trimmed(F.col("line"))
    step = F.when(told.rlike("^:::[A-Za-z0-9_]"), 1).when(told == ":::", -1)
    steps = rows.withColumn("step", step).where("step is not null")
    level = F.sum("step").over(Window.partitionBy(key).orderBy("at"))
    # The level above an opener and below its closer.
    crossed = steps.withColumn("boundary", level - F.when(F.col("step") == 1, 1).otherwise(0))
    paired = crossed.withColumn("closed", F.lead("at").over(Window.partitionBy(key, "boundary").orderBy("at")))
    return paired.where(F.col("line").rlike(f"^:::(?:{'|'.join(KINDS)})") & F.col("closed").isNotNull()).select(key, F.col("at").alias("opened"), "closed", "line")


def block_edits(pairs: DataFrame, key: str) -> DataFrame:
    """(key, edits): the lines that become elements, in order, as (at, text)."""
    kind = F.regexp_extract("line", f"^:::({'|'.join(KINDS)})", 1)
    title = trimmed(F.regexp_extract("line", rf"^:::(?:{'|'.join(KINDS)})\s+(.+)", 1))
    # Without a title a block is named by its kind; what is only white space is an empty title.
    named = F.when(F.col("line").rlike(rf"^:::(?:{'|'.join(KINDS)})\s+."), title).otherwise(F.upper(kind))
    details = kind == "details"
    head = F.concat(F.when(details, '<details class="details">').otherwise(F.concat(F.lit('<div class="box '), kind, F.lit('">'))), F.lit("\n<summary>"), named, F.lit("</summary>"))
    # A block without lines has an empty line within.
    head = F.when(F.col("closed") == F.col("opened") + 1, F.concat(head, F.lit("\n"))).otherwise(head)
    tail = F.when(details, "</details>\n").otherwise("</div>\n")
    both = F.inline(F.array(F.struct(F.col("opened").alias("at"), head.alias("text")), F.struct(F.col("closed").alias("at"), tail.alias("text"))))
    return pairs.select(key, both).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "text"))).alias("edits"))


def edited(lines: Column, edits: Column) -> Column:
    """The lines joined again, those in edits replaced; each line is copied once."""
    before = lambda k: F.when(k == 0, -1).otherwise(F.get(edits, k - 1)["at"])
    parts = F.transform(edits, lambda e, k: F.concat(F.slice(lines, before(k) + 2, e["at"] - before(k) - 1), F.array(e["text"])))
    last = F.element_at(edits, -1)["at"]
    rest = F.slice(lines, last + 2, F.size(lines) - last - 1)
    return F.array_join(F.concat(F.flatten(parts), rest), "\n")


def with_blocks(rows: DataFrame, text: str, as_column: str) -> DataFrame:
    """rows with the text's blocks as elements, in as_column; line ends become single ones.

    A text's marks are read once however often it occurs; null stays null."""
    digest, lines = "_digest", "_lines"
    parted = rows.withColumn(lines, lines_of(F.col(text)))
    marked = F.contains(F.col(text), F.lit(":::"))
    keyed = parted.withColumn(digest, F.when(marked, F.sha2(text, 256)))
    once = keyed.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.first(lines).alias(lines))
    edits = block_edits(block_pairs(once, digest, lines), digest)
    out = keyed.join(edits, digest, "left")
    plain = F.when(F.col(text).isNotNull(), F.array_join(lines, "\n"))
    return out.withColumn(as_column, F.when(F.col("edits").isNotNull(), edited(F.col(lines), F.col("edits"))).otherwise(plain)).drop(digest, lines, "edits")
