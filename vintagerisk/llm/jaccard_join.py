"""Near-duplicate texts by word-shingle Jaccard similarity, with Bayesian pruning of candidates.

A text is its run of words (letters and digits, lower case); texts with the same words are copies and are compared once.
Each text gets minima of 200 hash functions over its shingles. Candidates: texts that agree in one of 40 bands of five
minima; at similarity 0.8 a pair is missed with probability 1.3e-7, more similar pairs still more rarely. Texts that
are tied together by shared bands form a neighbourhood, and a neighbourhood is compared in blocks: a task holds the texts
of two blocks and compares minima some 20 at a time. After each step, a pair whose posterior probability of reaching the
threshold (uniform prior, so a Beta posterior) is below `tolerance` is dropped; the survivors' shingle sets are compared
exactly. A task returns a row per linked text, its number of links and the smallest text it is tied to, never the pairs.

Result, a row per document: class_id (the smallest doc_id tied to it by links), n_links (other texts at or above the
threshold), n_copies (rows with the same words). A dense group costs the square of its distinct texts in comparisons, but
in blocks that many tasks share, and only rows, not pairs, leave them.

Fewer words than a shingle: the whole run is one shingle. Null, empty or wordless text: no links, a class of its own.
Null doc_ids are last when a class is named; a class of nulls has a null class_id. Repeated rows are copies. No rows:
no rows. Other columns of the input are not read, except that `without_near_duplicates` returns all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagerisk.llm.components import components
from vintagerisk.llm.frames import give_back, hex_sha256, land, partitions, pick

WORDS, THRESHOLD = 5, Fraction(4, 5)
BANDS, PER_BAND, STEP = 40, 5, 20
HASHES = BANDS * PER_BAND
BLOCK = 512


def words_of(text: Column) -> Column:
    """The words, one space between them; empty for null."""
    return F.array_join(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " ")


def shingles(words: list[str], size: int = WORDS) -> list[str]:
    return [" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))] if words else []


def fewest_matches(threshold: Fraction, tolerance: float, step: int = STEP, hashes: int = HASHES) -> list[int]:
    """After each step: the number of equal minima below which a pair is dropped.

    With m of n equal the posterior is Beta(m + 1, n - m + 1); that it exceeds t is the chance of m or fewer successes in
    n + 1 trials of probability t.
    """
    out, t = [], float(threshold)
    for n in range(step, hashes + 1, step):
        chance, m = 0.0, 0
        while (chance := chance + math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)) < tolerance:
            m += 1
        out.append(m)
    return out


class Minima:
    """Minima of the hash functions over the shingles of a text, and its band keys."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 2**32, HASHES, dtype=np.uint32)
        self.mix = rng.integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.band = rng.integers(0, 2**63, (BANDS, PER_BAND), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.known: dict[str, int] = {}

    def word_hashes(self, words: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > 500_000:
                known.clear()
            known.update((w, xxhash.xxh3_64_intdigest(w)) for w in set(words) if w not in known)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def __call__(self, words: list[str]) -> np.ndarray:
        each = self.word_hashes(words)
        count = max(1, len(each) - WORDS + 1)
        h = np.full(count, min(len(each), WORDS), np.uint64)
        for k in range(min(WORDS, len(each))):
            h += each[k : k + count] * self.mix[k]
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h = (h >> np.uint64(32)).astype(np.uint32)
        least = np.full(HASHES, 2**32 - 1, np.uint32)
        for k in range(0, count, 1024):
            np.minimum(least, (h[k : k + 1024, None] * self.a + self.b).min(0), out=least)
        return least

    def bands(self, least: np.ndarray) -> np.ndarray:
        keys = ((least.reshape(BANDS, PER_BAND).astype(np.uint64) + np.uint64(1)) * self.band).sum(1, dtype=np.uint64)
        keys ^= keys >> np.uint64(31)
        return (keys * np.uint64(0x9E3779B97F4A7C15) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """row, doc_id, words_id (SHA-256 of the words), minima, bands; docs: doc_id, words. Landed, so that rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minima = Minima()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                made = [minima(w.split(" ")) if (w := x.as_py()) else None for x in part.column("words")]
                bands = [None if m is None else minima.bands(m) for m in made]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("words_id"), pa.array([None if m is None else m.tobytes() for m in made], pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    ["doc_id", "words_id", "minima", "bands"],
                )
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", "words", hex_sha256(F.col("words")).alias("words_id")).mapInArrow(run, f"doc_id {kind}, words_id string, minima binary, bands array<long>")
    return land(made.select(F.monotonically_increasing_id().alias("row"), "*"), "signatures")


def neighbourhoods(texts: DataFrame) -> DataFrame:
    """(node, root): texts (row, bands) that shared bands tie together, directly or through others; single ones are left out."""
    keyed = texts.select("row", F.explode("bands").alias("key"))
    shared = land(keyed.groupBy("key").agg(F.min("row").alias("least"), F.max("row").alias("most")).where("least < most").select("key", "least"), "shared")
    ties = keyed.join(shared, "key").where("row > least").select("row", "least").distinct()
    tied = components(ties, "row", "least")
    return land(tied.union(tied.select("root", "root").distinct()), "neighbourhoods")


def compared(members: DataFrame, threshold: Fraction, tolerance: float) -> DataFrame:
    """(row, n_links, least) of linked texts, by block pair; members: root, i, j, block, row, minima, words."""
    fewest = fewest_matches(threshold, tolerance)
    num, den = threshold.numerator, threshold.denominator

    def links(rows: list[tuple[int, int, bytes, str]], i: int, j: int) -> list[tuple[int, int, int]]:
        rows = list({r[1]: r for r in rows}.values())
        block = np.array([r[0] for r in rows])
        minima = np.frombuffer(b"".join(r[2] for r in rows), np.uint32).reshape(len(rows), HASHES)
        sets: dict[int, set[int]] = {}
        names: dict[str, int] = {}

        def set_of(k: int) -> set[int]:
            if k not in sets:
                sets[k] = {names.setdefault(s, len(names)) for s in shingles(rows[k][3].split(" "))}
            return sets[k]

        one, two = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if i == j:
            a, b = np.triu_indices(len(one), 1)
            a, b = one[a], one[b]
        else:
            a, b = np.repeat(one, len(two)), np.tile(two, len(one))
        equal = np.zeros(len(a), np.int64)
        for n, least in enumerate(fewest):
            span = slice(n * STEP, (n + 1) * STEP)
            equal += (minima[a, span] == minima[b, span]).sum(1)
            alive = equal >= least
            a, b, equal = a[alive], b[alive], equal[alive]
        count, parent = [0] * len(rows), list(range(len(rows)))

        def find(k: int) -> int:
            while parent[k] != k:
                parent[k] = k = parent[parent[k]]
            return k

        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = set_of(x), set_of(y)
            if num * max(len(p), len(q)) > den * min(len(p), len(q)):
                continue
            if len(p & q) * (den + num) >= num * (len(p) + len(q)):
                count[x] += 1
                count[y] += 1
                u, v = find(x), find(y)
                if u != v:
                    parent[max(u, v)] = min(u, v)
        least_row: dict[int, int] = {}
        for k in range(len(rows)):
            r = find(k)
            least_row[r] = min(least_row.get(r, rows[k][1]), rows[k][1])
        return [(rows[k][1], count[k], least_row[find(k)]) for k in range(len(rows)) if count[k]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    yield from zip(*(c.to_pylist() for c in batch.slice(at, 500).columns), strict=True)

        for (_, i, j), rows in groupby(stream(), key=lambda r: r[:3]):
            if found := links([r[3:] for r in rows], i, j):
                row, n, least = zip(*found, strict=True)
                yield pa.RecordBatch.from_pydict({"row": pa.array(row, pa.int64()), "n_links": pa.array(n, pa.int64()), "least": pa.array(least, pa.int64())})
        give_back()

    dealt = members.select("root", "i", "j", "block", "row", "minima", "words").repartition(partitions(members.sparkSession), "root", "i", "j")
    return dealt.sortWithinPartitions("root", "i", "j").mapInArrow(run, "row long, n_links long, least long")


def near_duplicates(
    docs: DataFrame, threshold: Fraction = THRESHOLD, tolerance: float = 1e-7, block: int = BLOCK, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, class_id, n_links, n_copies, words_id: a row per document."""
    source = pick(docs, doc_id=doc_id, text=text).select("doc_id", words_of(F.col("text")).alias("words"))
    rows = signatures(source)
    copies = land(rows.where("minima IS NOT NULL").groupBy("words_id").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n_copies"), F.min("doc_id").alias("doc_id")), "copies")
    texts = rows.select("row", "bands").join(copies.select(F.col("first").alias("row")).hint("shuffle_hash"), "row", "left_semi")
    near = neighbourhoods(texts)
    size = land(near.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")), "sizes")
    own = near.join(size, "root").select("root", F.col("node").alias("row"), "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    own = own.join(rows.select("row", "doc_id", "words_id", "minima"), "row")
    own = source.withColumn("words_id", hex_sha256(F.col("words"))).alias("s").join(
        own.hint("shuffle_hash").alias("o"), F.col("s.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("s.words_id") == F.col("o.words_id"))
    ).select("o.root", "o.row", "o.blocks", "o.block", "o.minima", "s.words")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    members = own.select("*", other.alias("other")).select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "row", "minima", "words")
    found = land(compared(members, threshold, tolerance), "links")
    links = found.groupBy("row").agg(F.sum("n_links").alias("n_links")).withColumnRenamed("row", "linked")
    tied = components(found, "row", "least")
    text_class = copies.join(tied, F.col("first") == F.col("node"), "left").join(links, F.col("first") == F.col("linked"), "left").select(
        "words_id", "n_copies", "doc_id", F.coalesce("root", "first").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    text_class = land(text_class, "classes")
    named = land(text_class.groupBy("root").agg(F.min("doc_id").alias("class_id")), "class-names")
    text_class = land(text_class.join(named, "root").select("words_id", "class_id", "n_links", "n_copies"), "named-classes")
    none = F.col("minima").isNull()
    plain = rows.where(none).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), "words_id")
    full = rows.where(~none).select("doc_id", "words_id").join(text_class, "words_id").select("doc_id", "class_id", "n_links", "n_copies", "words_id")
    return full.unionByName(plain)


def without_near_duplicates(docs: DataFrame, threshold: Fraction = THRESHOLD, tolerance: float = 1e-7, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay: of each class the document with the smallest doc_id, and all documents without words.

    Rows that share a doc_id and the words stay or go together; a class in which every doc_id is null stays whole.
    """
    found = near_duplicates(docs, threshold, tolerance, doc_id=doc_id, text=text).where(~F.col("doc_id").eqNullSafe(F.col("class_id")))
    gone = land(found.select("doc_id", "words_id"), "gone").distinct().alias("g")
    own = docs.alias("d")
    key = hex_sha256(words_of(F.col(f"d.`{text}`")))
    return own.join(gone.hint("shuffle_hash"), F.col(f"d.`{doc_id}`").eqNullSafe(F.col("g.doc_id")) & (key == F.col("g.words_id")), "left_anti")
