"""Small integers in place of repeated words, so that "the newest word" is found in a hash aggregate.

Spark keeps the newest number of a group in place; for a string it sorts all rows first.  A code book lists the distinct
words of some columns.  It is broadcast, so its size is checked: with more words than `LARGEST_BOOK`, or very long ones,
there is no book and the operators work on the strings themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LARGEST_BOOK = 100_000
LONGEST_WORD = 200


def code_book(df: DataFrame, columns: list[str], largest: int = LARGEST_BOOK) -> DataFrame | None:
    """(name, word, code) of the words in `columns`, in the order of their names and words; None if they are too many.

    Reads the columns once; map-side, each task leaves its distinct words.
    """
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    words = df.selectExpr(f"stack({len(columns)}, {pairs}) AS (name, word)").where("word IS NOT NULL").distinct()
    found = words.selectExpr("name", f"CASE WHEN length(word) <= {LONGEST_WORD} THEN word END AS word").limit(largest + 1).collect()
    if len(found) > largest or any(r.word is None for r in found):
        return None
    rows = [(name, word, code) for code, (name, word) in enumerate(sorted((r.name, r.word) for r in found))]
    return df.sparkSession.createDataFrame(rows, "name string, word string, code int")


def encode(df: DataFrame, columns: list[str], book: DataFrame) -> DataFrame:
    """Words become codes, NULL stays; a word that the book does not know stops the job."""
    for c in columns:
        page = book.where(F.col("name") == c).select(F.col("word").alias("book_word"), F.col("code").alias("book_code"))
        known = F.when(F.col(c).isNull() | F.col("book_code").isNotNull(), F.col("book_code")).otherwise(
            F.raise_error(F.concat(F.lit(f"no code for {c} "), F.col(c))).cast("int")
        )
        df = df.join(F.broadcast(page), F.col(c) == F.col("book_word"), "left").withColumn(c, known).drop("book_word", "book_code")
    return df


def decode(df: DataFrame, columns: list[str], book: DataFrame) -> DataFrame:
    for c in columns:
        page = book.where(F.col("name") == c).select(F.col("word").alias("book_word"), F.col("code").alias("book_code"))
        df = df.join(F.broadcast(page), F.col(c) == F.col("book_code"), "left").withColumn(c, F.col("book_word")).drop("book_word", "book_code")
    return df
