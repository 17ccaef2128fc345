"""Secret scans over an incremental blob ledger, inside Spark's own functions.

Every historical version of every path is content-addressed: its blob is the SHA-256 of its text. The ledger, a Parquet
table, holds a row for each (blob, rule, rule version) that was scanned, with the spans found, also where none were. A
scan forms the pairs of distinct blobs and present rule versions, takes away those the ledger has, reads the text of one
version per blob that still has pairs, scans it by the rules that it lacks, appends to the ledger, and joins the ledger's
spans back to all paths. A second scan of the same versions reads no text a second time; a new rule version scans again
by that rule only.

Positions come from Spark's regular expressions: `split` gives the gaps, `regexp_extract_all` the matches, and a running
sum over their lengths in code points gives starts and ends. Copies share one blob, so a hot text is scanned once, and
the join back is a plain equi-join whose large side Spark can split.

Null text counts as empty. Rows are returned one for one, repeated rows and null paths too. Texts of any length are
scanned whole. No rows: no rows, and an unchanged ledger. Only the named columns of the input are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vintagerisk.llm.frames import hex_sha256, land, pick


@dataclass(frozen=True)
class Rule:
    """A match counts if group `group` of it has `least` characters or more; others are dropped but use up their text."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1


# fixed values: the kinds in the order in which they are listed. A run of hex digits, or of capitals and digits after
# AKIA, is matched whole or not at all, so its least length can stand in the pattern.
BASE_RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)
# what the base kinds leave out: the head line of a private key
RULES = (*BASE_RULES, Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"))

LEDGER = "blob string, kind string, rule_version int, spans array<struct<start:bigint,end:bigint>>"


def create_ledger(spark: SparkSession, ledger: str) -> str:
    spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(ledger)
    return ledger


def matches(text: Column, rule: Rule) -> Column:
    """array<struct<gap, size, value>>: lengths of the text before each match, of the match, and of its decisive group."""
    part = lambda group: F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(group)), lambda m: F.length(m))
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda g: F.length(g))
    rows = F.arrays_zip(gaps.alias("gap"), part(0).alias("size"), part(rule.group).alias("value"))
    found = F.filter(rows, lambda r: r["size"].isNotNull())  # the last gap has no match after it
    return F.when(text.rlike(rule.pattern), found).otherwise(F.filter(rows, lambda r: F.lit(False)))


def unseen(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, path of one version that has it, kinds still to scan it by."""
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("rule_version")) for r in rules])
    pairs = versions.groupBy("blob").agg(F.min("path").alias("path")).select("blob", "path", F.inline(wanted))
    left = pairs.join(ledger.select("blob", "kind", "rule_version"), ["blob", "kind", "rule_version"], "left_anti")
    return left.groupBy("blob", "path").agg(F.collect_list("kind").alias("kinds"))


def spans_of(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows for (blob, text, kinds): one for each blob and kind."""
    each = [F.when(F.array_contains("kinds", r.kind), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("rule_version"), F.lit(r.least).alias("least"), matches(F.col("text"), r).alias("found"))) for r in rules]
    scanned = texts.select("blob", F.filter(F.array(*each), lambda p: p.isNotNull()).alias("pairs")).dropDuplicates(["blob"])
    rows = scanned.select("blob", F.inline("pairs")).select("blob", "kind", "rule_version", "least", F.posexplode_outer("found").alias("pos", "hit"))
    placed = rows.selectExpr(
        "blob", "kind", "rule_version", "hit.value >= least AS good", "hit.size AS size",
        "sum(hit.gap + hit.size) OVER (PARTITION BY blob, kind ORDER BY pos) AS end",
    )
    span = F.struct((F.col("end") - F.col("size")).alias("start"), F.col("end").alias("end"))
    return placed.groupBy("blob", "kind", "rule_version").agg(F.array_sort(F.collect_list(F.when(F.col("good"), span))).alias("spans"))


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, path: str = "path", text: str = "text") -> DataFrame:
    """Bring the ledger up to date and return a row per version: path, blob, spans array<struct<start, rank, end, kind>>.

    Spans are in order of start, then of the rules; ends are exclusive.
    """
    spark = versions.sparkSession
    source = pick(versions, path=path, text=text).select("path", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", hex_sha256(F.col("text")))
    known = spark.read.schema(LEDGER).parquet(ledger)
    rows = land(source.select("path", "blob"), "versions")
    todo = land(unseen(rows, known, rules), "unseen")
    texts = source.alias("s").join(
        todo.hint("shuffle_hash").alias("t"), F.col("s.blob").eqNullSafe(F.col("t.blob")) & F.col("s.path").eqNullSafe(F.col("t.path"))
    ).select("s.blob", "s.text", "t.kinds")
    if not todo.isEmpty():
        spans_of(texts, rules).write.mode("append").parquet(ledger)
    rank = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(k))])
    present = F.concat_ws(":", "kind", "rule_version").isin([f"{r.kind}:{r.version}" for r in rules])
    found = spark.read.schema(LEDGER).parquet(ledger).where((F.size("spans") > 0) & present)
    listed = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), rank[F.col("kind")].alias("rank"), s["end"].alias("end"), F.col("kind").alias("kind")))
    by_blob = land(found.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(listed))).alias("spans")), "found")
    empty = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    return rows.join(by_blob, "blob", "left").select("path", "blob", F.coalesce("spans", empty).alias("spans"))


def without_secrets(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` in whose text no rule finds anything, with all their columns."""
    found = scan(docs, ledger, rules, doc_id, text).where(F.size("spans") > 0).select("blob").distinct().alias("f")
    blob = hex_sha256(F.coalesce(F.col(f"d.`{text}`"), F.lit("")))
    return docs.alias("d").join(found.hint("shuffle_hash"), blob == F.col("f.blob"), "left_anti")


def listing(spans: Column, kinds: list[str] | None = None) -> Column:
    """`kind:start:end` of the spans, comma-joined."""
    own = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
