"""Documents with nulls, repeats, empty and long texts, and columns whose names the operators use themselves."""

import duckdb

from tools.check import TABLES, canonical

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"long{k % 977} word" for k in range(30_000))
ROWS = [
    (1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b\tc d \n e f g"), (3, None), (4, ""), (5, "  \n "), (6, "One Two"), (7, "one two"),
    (None, "a b c d e f g"), (None, "only here, without a number"), (8, LONG), (9, LONG + " tail"), (10, LONG), (11, "Straße 日本語 😀 naïve ½ x²"), (12, "7 + 7 = 14"),
    (13, "x" * 9_000), (14, "x" * 9_001), (15, "don't  stop<|endoftext|>   now\x1c "),
]
NAMES = ["row", "name", "block", "blob", "path", "key", "ids", "start", "shard", "slot", "words", "kinds", "spans", "part", "bin", "__row"]


def documents(spark, rows=ROWS):
    """doc_id, text, lang, and clashing further columns."""
    full = [(i, t, "en", *[k] * len(NAMES)) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, " + ", ".join(f"`{n}` int" for n in NAMES))


def stored(spark, rows=ROWS):
    """The same as a table, as operators meet it."""
    from vintagerisk.llm.frames import land

    return land(documents(spark, rows).repartition(3, "row"), "cases")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def same_as_sql(spark, name, sf=SF):
    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    cursor = con.execute(entry.oracle_sql()[name])
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(cursor.fetchall(), [d[0] for d in cursor.description])
