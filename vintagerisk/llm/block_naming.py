"""Exact deduplication by deterministic block naming, inside Spark's own functions.

The normalised text is cut into blocks of a fixed number of characters. Distinct blocks are sorted and numbered: the
number is the block's name. Then names of adjacent pairs are sorted and numbered in the same way, level by level, each
level half as long, until every document has one name. Two documents with equally many blocks have the same name if
and only if their texts are equal; no hash decides it.

Text travels once, to the sort that names the blocks. To find its name again a block carries a 64-bit locator, and the
naming table shows for each locator whether it stands for one block only; blocks that share a locator with a different
block are named a second time by their whole content. So a weak locator costs time, never a wrong name.

Null text counts as empty. Of equal texts the smallest doc_id stays, null doc_ids last; repeated rows of the doc_id that
stays are all marked as kept (`deduplicate` returns one of them). No rows: no rows. Other columns of the input are not read by `identities`;
`deduplicate` returns all of them. The input is a table: it is read more than once, and its rows are told by their place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagerisk.llm.frames import hex_sha256, land, pick

BLOCK_CHARS = 4096


def normalised(text: Column) -> Column:
    """Runs of space, tab, line feed, vertical tab, form feed and carriage return become one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def blocks(text: Column, size: int) -> Column:
    """The text in blocks of `size` characters, the last may be shorter; empty text is one empty block."""
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(F.length(text) == 0, F.array(F.lit(""))).otherwise(cut)


def numbered(distinct: DataFrame, *by: str) -> DataFrame:
    """Names for distinct rows: the place in the sort order of their partition. Landed, so a name never changes."""
    return land(distinct.sortWithinPartitions(*by).select(*by, F.monotonically_increasing_id().alias("name")), "names")


def identities(docs: DataFrame, size: int = BLOCK_CHARS, locator=F.xxhash64, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: row (own number), doc_id, text_sha256, n_blocks, name; equal (n_blocks, name) means equal text."""
    source = pick(docs, doc_id=doc_id, text=text).select("doc_id", normalised(F.col("text")).alias("text"))
    cut = source.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", blocks(F.col("text"), size).alias("blocks"))
    rows = land(cut.select("row", "doc_id", hex_sha256(F.col("text")).alias("text_sha256"), F.transform("blocks", lambda b: locator(b)).alias("at")), "rows")
    every = cut.select(F.explode("blocks").alias("block")).select(locator(F.col("block")).alias("at"), "block")
    # the block itself is sorted on, but only its locator is written beside the name
    first = land(every.distinct().sortWithinPartitions("block").select("at", F.monotonically_increasing_id().alias("name")), "block-names")
    named = land(first.groupBy("at").agg(F.count(F.lit(1)).alias("of"), F.min("name").alias("name")), "locators")
    places = rows.select("row", F.size("at").alias("n"), F.posexplode("at").alias("pos", "at"))
    level = places.join(named, "at").select("row", "n", "pos", "at", F.when(F.col("of") == 1, F.col("name")).alias("name"))
    shared = named.where("of > 1").select("at")
    if not shared.isEmpty():
        level = _by_content(level, cut, shared, locator)
    level = land(level.select("row", "n", "pos", "name"), "level")
    done = [level.where("n = 1").select("row", F.lit(1).cast("long").alias("n_blocks"), "name")]
    longest = rows.agg(F.max(F.size("at"))).first()[0] or 1
    sizes = rows.select("row", F.size("at").cast("long").alias("n_blocks"))
    level = level.where("n > 1")
    while longest > 1:
        pairs = level.groupBy("row", "n", F.shiftright("pos", 1).alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right")
        )
        pairs = land(pairs, "pairs")
        names = numbered(pairs.select("left", "right").distinct(), "left", "right")
        level = land(pairs.join(names, ["left", "right"]).select("row", F.ceil(F.col("n") / 2).cast("int").alias("n"), "pos", "name"), "level")
        done.append(level.where("n = 1").select("row", "name").join(sizes, "row").select("row", "n_blocks", "name"))
        level = level.where("n > 1")
        longest = -(-longest // 2)
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    return rows.select("row", "doc_id", "text_sha256").join(found, "row")


def _by_content(level: DataFrame, cut: DataFrame, shared: DataFrame, locator) -> DataFrame:
    """Names for the blocks whose locator stands for several blocks; negative, so that they meet no other name."""
    every = cut.select("row", F.posexplode("blocks").alias("pos", "block")).withColumn("at", locator(F.col("block")))
    content = land(every.join(shared, "at", "left_semi").select("row", "pos", "block"), "shared-blocks")
    own = numbered(content.select("block").distinct(), "block").select("block", (-2 - F.col("name")).alias("own"))
    where = content.join(own, "block").select("row", "pos", "own")
    return level.join(where, ["row", "pos"], "left").withColumn("name", F.coalesce("name", "own"))


def duplicates(docs: DataFrame, size: int = BLOCK_CHARS, locator=F.xxhash64, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256."""
    found = land(identities(docs, size, locator, doc_id, text), "identities")
    groups = land(found.groupBy("n_blocks", "name").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    return found.join(groups, ["n_blocks", "name"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def deduplicate(docs: DataFrame, size: int = BLOCK_CHARS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns: one row of each distinct normalised text."""
    found = land(identities(docs, size, doc_id=doc_id, text=text), "identities")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    stay = found.groupBy("n_blocks", "name").agg(first).select("first.doc_id", F.col("first.row").alias("row"))
    own = docs.select(F.monotonically_increasing_id().alias("__row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__all"))
    return own.join(stay, F.col("__row") == F.col("row"), "left_semi").select("__all.*")
