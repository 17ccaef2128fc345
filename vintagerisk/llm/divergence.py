"""How far a source's wording departs from its language and from the language's other sources.

Single-pass in-memory indexing: a task gathers documents in a block until it holds `block_bytes`, counts the postings of
its terms, and spills it as a run, sorted by term and cut into pieces by hash shard. Each shard's task opens the pieces of
all runs in the order of their first terms and merges them with a heap into one entry per (language, term); only the open
pieces are in memory. Documents are read once, and a frequent term costs one entry per run and source, not one per occurrence.

Terms are maximal runs of ASCII letters and non-ASCII characters, A-Z lower-cased. A language keeps the terms of at least
`min_docs` of its documents. p = 1 + floor(SCALE * (count + 1) / (total + vocabulary)) for each kept term, of a group
(language, source) or of the whole language; f(p, q) = floor((p - q)^2 / q), all in integers.

The divergence of two sources sums f over the whole vocabulary, yet most terms are absent from either. With p0, q0 the
values of absent terms, the sum is what it would be if no term were shared, which needs only how many terms a source
holds how often, plus a correction for each shared term: f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0). The corrections are
streamed term by term and summed in the tasks before they are shuffled.

Null text, language and source count as ''. Every group that occurs is reported, even without terms; a language without
kept terms gives the value 0. Repeated rows and rows with the same doc_id count as documents of their own; further columns are not
read. An empty table gives no rows. Sums stay below 2^63 for vocabularies up to a thousand million terms; beyond, Spark's
overflow error stops the job.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintagerisk.llm.chunks import gather
from vintagerisk.llm.frames import land, partitions

SCALE = 1_000_000_000
MIN_DOCS = 3
TOP_TERMS = 200
PIECE = 4096  # terms of a run that travel together
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
EVERY = b""  # stands in every document, so the merge also returns the groups and their documents

RUNS = "shard int, lang string, first binary, terms array<binary>, docs array<bigint>, sizes array<int>, sources array<string>, counts array<bigint>"
INDEX = "lang string, term binary, docs bigint, sources array<string>, counts array<bigint>"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


class Block:
    """Texts of a block, at most about `size` bytes or one longer text, and their inversion."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, str]] = []
        self.texts: list[bytes] = []
        self.size = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        self.rows.append((lang, source))
        self.texts.append(text.translate(TERM_BYTES))
        self.size += len(text)

    def run(self, shards: int) -> Iterator[pa.RecordBatch]:
        """Pieces of one run per language: shard by shard, terms ascending."""
        if not self.rows:
            return
        groups = {g: k for k, g in enumerate(sorted(set(self.rows)))}
        langs = {lang: k for k, lang in enumerate(sorted({lang for lang, _ in groups}))}
        lang_of = np.array([langs[lang] for lang, _ in groups])
        group = np.fromiter((groups[r] for r in self.rows), np.int64, len(self.rows))
        # splitting leaves an empty string before a leading space: the empty term, which each document gets once
        words = pc.ascii_split_whitespace(pa.array([b" " + t if t else t for t in map(bytes.strip, self.texts)], pa.binary()).view(pa.string()))
        coded = words.flatten().dictionary_encode()
        doc = np.repeat(np.arange(len(self.rows)), np.diff(np.asarray(words.offsets)))
        terms = coded.dictionary.cast(pa.binary())
        rank, order = np.empty(len(terms), np.int64), np.asarray(pc.array_sort_indices(terms))
        rank[order] = np.arange(len(terms))
        terms = terms.take(pa.array(order))
        pairs, count = np.unique(doc * len(terms) + rank[np.asarray(coded.indices)], return_counts=True)
        doc, term = pairs // len(terms), pairs % len(terms)
        del words, coded, pairs
        held, of_doc = np.unique(term * len(groups) + group[doc], return_inverse=True)
        count = np.bincount(of_doc, count).astype(np.int64)
        docs = np.bincount(of_doc)
        term, source = held // len(groups), held % len(groups)
        shard = np.fromiter(map(crc32, terms.to_pylist()), np.int64, len(terms)) % shards
        names = pa.array([s for _, s in groups], pa.string())
        for lang, k in langs.items():
            mine = np.flatnonzero(lang_of[source] == k)
            own, start, size = np.unique(term[mine], return_index=True, return_counts=True)
            n = np.add.reduceat(docs[mine], start)
            order = np.argsort(shard[own], kind="stable")
            at = mine[gather(start[order], size[order], np.arange(len(mine)))]
            edge = np.flatnonzero(np.r_[True, np.diff(shard[own][order]) != 0, True])
            cuts = np.unique(np.concatenate([[len(order)], *[np.arange(a, b, PIECE) for a, b in zip(edge[:-1], edge[1:], strict=True)]]))
            of_terms, of_held = pa.array(cuts, pa.int32()), pa.array(np.r_[0, np.cumsum(size[order])][cuts], pa.int32())
            sorted_terms = terms.take(pa.array(own[order]))
            listed = lambda offsets, values: pa.ListArray.from_arrays(offsets, values)
            yield pa.record_batch(
                [
                    pa.array(shard[own][order][cuts[:-1]], pa.int32()), pa.array([lang] * (len(cuts) - 1), pa.string()), sorted_terms.take(pa.array(cuts[:-1])),
                    listed(of_terms, sorted_terms), listed(of_terms, pa.array(n[order])), listed(of_terms, pa.array(size[order], pa.int32())),
                    listed(of_held, names.take(pa.array(source[at]))), listed(of_held, pa.array(count[at])),
                ],
                ["shard", "lang", "first", "terms", "docs", "sizes", "sources", "counts"],
            )


class Piece:
    """A piece of a run while it is merged; `at` terms of it are done."""

    def __init__(self, row: dict[str, pa.Scalar]) -> None:
        self.terms, self.sources = row["terms"].values, row["sources"].values
        self.docs, self.counts = (row[c].values.to_numpy() for c in ("docs", "counts"))
        self.ends = np.r_[0, np.cumsum(row["sizes"].values.to_numpy())]
        self.last = self.terms[-1].as_py()
        self.at = 0

    def upto(self, bound: bytes | None) -> int:
        return len(self.docs) if bound is None or self.last < bound else pc.sum(pc.less(self.terms, bound)).as_py()


def merged(pieces: Iterator[dict[str, pa.Scalar]], min_docs: int, window: int = 200_000) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, pa.Array, np.ndarray]]:
    """(terms, documents, sizes, sources, counts) in term order, of pieces in the order of their first terms.

    A heap holds the open pieces by their last terms. What lies before the first term of the next piece is complete in
    the open ones and is merged at once; the heap gives up the pieces this ends. Pieces are opened until that is about half of what they hold.
    """
    heap: list[tuple[bytes, int, Piece]] = []
    upcoming, opened, most = next(pieces, None), 0, window
    while heap or upcoming:
        while upcoming and sum(len(p.docs) - p.at for _, _, p in heap) < most:
            piece = Piece(upcoming)
            heapq.heappush(heap, (piece.last, opened, piece))
            upcoming, opened = next(pieces, None), opened + 1
        bound = upcoming["first"].as_py() if upcoming else None
        stops = [(p, p.upto(bound)) for _, _, p in heap]
        if upcoming and 2 * sum(stop - p.at for p, stop in stops) < sum(len(p.docs) - p.at for p, _ in stops):
            most *= 2
            continue
        most = window
        yield _together([(p, p.at, stop) for p, stop in stops if stop > p.at], min_docs)
        for p, stop in stops:
            p.at = stop
        while heap and (bound is None or heap[0][0] < bound):
            heapq.heappop(heap)


def _together(parts: list[tuple[Piece, int, int]], min_docs: int) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    coded = pa.concat_arrays([p.terms.slice(a, b - a) for p, a, b in parts]).dictionary_encode()
    number = np.asarray(coded.indices, np.int64)
    docs = np.bincount(number, np.concatenate([p.docs[a:b] for p, a, b in parts])).astype(np.int64)
    keep = docs >= min_docs
    for k, term in enumerate(coded.dictionary[:1] if number.size else []):
        keep[k] |= term.as_py() == EVERY  # the smallest term there is
    order = np.flatnonzero(keep)[np.asarray(pc.array_sort_indices(coded.dictionary.filter(pa.array(keep))), np.int64)]
    place = np.full(len(keep), -1, np.int64)
    place[order] = np.arange(len(order))
    sizes = np.concatenate([np.diff(p.ends[a : b + 1]) for p, a, b in parts])
    term = np.repeat(place[number], sizes)
    kept = term >= 0
    sources = pa.concat_arrays([p.sources.slice(p.ends[a], p.ends[b] - p.ends[a]) for p, a, b in parts]).filter(pa.array(kept)).dictionary_encode()
    counts = np.concatenate([p.counts[p.ends[a] : p.ends[b]] for p, a, b in parts])[kept]
    width = max(1, len(sources.dictionary))
    held, of = np.unique(term[kept] * width + np.asarray(sources.indices, np.int64), return_inverse=True)
    total = np.zeros(len(held), np.int64)
    np.add.at(total, of, counts)
    return coded.dictionary.take(pa.array(order)), docs[order], np.bincount(held // width, minlength=len(order)), sources.dictionary.take(pa.array(held % width)), total


def term_index(docs: DataFrame, min_docs: int = MIN_DOCS, block_bytes: int = 1 << 23) -> DataFrame:
    """(lang, term, docs, sources, counts) of the kept terms; under the term '' the groups and their documents."""
    spark = docs.sparkSession
    parts = partitions(spark)
    shards = 8 * parts
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")).alias("text"),
    )

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block()
        for batch in batches:
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for lang, source, text in zip(langs, sources, batch.column("text"), strict=True):
                block.add(lang, source, text.as_py())
                if block.size >= block_bytes:
                    yield from block.run(shards)
                    block = Block()
        yield from block.run(shards)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (dict(zip(batch.schema.names, row, strict=True)) for batch in batches for row in zip(*batch.columns, strict=True))
        for (_, lang), pieces in groupby(rows, key=lambda r: (r["shard"].as_py(), r["lang"].as_py())):
            for terms, n, sizes, sources, counts in merged(iter(pieces), min_docs):
                offsets = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, sources), pa.ListArray.from_arrays(offsets, pa.array(counts))]
                yield pa.record_batch([pa.array([lang] * len(terms), pa.string()), terms, pa.array(n), *lists], ["lang", "term", "docs", "sources", "counts"])

    runs = texts.mapInArrow(invert, RUNS).repartition(parts, "shard").sortWithinPartitions("shard", "lang", "first")
    return runs.mapInArrow(merge, INDEX)


def frequency(count: str, total: str, vocabulary: str) -> str:
    return f"1 + (cast({SCALE} as decimal(10,0)) * ({count} + 1)) DIV ({total} + {vocabulary})"


def gap(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) DIV {q}"


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` with all other sources of the language, part `term` with the `top` terms."""
    index = land(term_index(docs, min_docs), "term-index")
    kept = index.where("term <> X''")
    postings = kept.selectExpr("lang", "term", "aggregate(counts, 0L, (a, c) -> a + c) AS lang_count", "inline(arrays_zip(sources, counts)) AS (source, count)")
    groups = index.where("term = X''").selectExpr("lang", "explode(sources) AS source")
    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum(F.expr("aggregate(counts, 0L, (a, c) -> a + c)")).alias("lang_n"))
    of_group = postings.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("n_terms"))
    totals = groups.join(of_lang, "lang", "left").join(of_group, ["lang", "source"], "left").selectExpr(
        "lang", "source", "coalesce(v, 0L) AS v", "coalesce(lang_n, 0L) AS lang_n", "coalesce(n, 0L) AS n", "coalesce(n_terms, 0L) AS n_terms"
    )
    totals = land(totals.withColumn("p0", F.expr(f"CASE WHEN v > 0 THEN {frequency('0L', 'n', 'v')} ELSE 1L END")), "source-totals")
    rated = land(
        postings.join(totals, ["lang", "source"]).selectExpr(
            "lang", "source", "term", f"{frequency('count', 'n', 'v')} AS p", "p0", f"{frequency('lang_count', 'lang_n', 'v')} AS q"
        ),
        "rated-terms",
    )
    return _pairs(totals, rated).unionByName(_terms(rated, top))


def _terms(rated: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    ranked = rated.where("p > q").selectExpr("lang", "source", "term", f"{gap('p', 'q')} AS value").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top).selectExpr("lang", "source", "'term' AS part", "cast(term as string) AS item", "value", "rank")


def _pairs(totals: DataFrame, rated: DataFrame) -> DataFrame:
    """Values of all ordered pairs of a language's sources: absent terms, one-sided terms, corrections of shared terms."""
    other = totals.selectExpr("lang", "source AS item", "p0 AS q0", "n_terms AS item_terms")
    base = totals.join(other, "lang").where("source <> item").selectExpr(
        "lang", "source", "item", f"CASE WHEN v > 0 THEN {gap('p0', 'q0')} * (v - n_terms - item_terms) ELSE 0L END AS value"
    )
    salts = partitions(totals.sparkSession)
    profile = rated.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("n")).withColumn("salt", F.expr(f"pmod(xxhash64(source, p), {salts})"))
    spread = other.selectExpr("lang", "item", "q0", f"explode(sequence(0L, {salts - 1}L)) AS salt")
    sided = profile.join(spread, ["lang", "salt"]).where("source <> item")
    sums = sided.groupBy("lang", "source", "item").agg(F.sum(F.expr(f"n * ({gap('p', 'q0')})")).alias("own"), F.sum(F.expr(f"n * ({gap('q0', 'p')})")).alias("theirs"))
    one_sided = sums.selectExpr("lang", "inline(array(struct(source, item, own AS value), struct(item AS source, source AS item, theirs AS value)))")
    total = base.unionByName(one_sided).unionByName(shared_corrections(rated)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return total.selectExpr("lang", "source", "'pair' AS part", "item", "value").withColumn("rank", F.row_number().over(order))


def shared_corrections(rated: DataFrame, pairs: int = 1 << 20, held: int = 1 << 18) -> DataFrame:
    """(lang, source, item, value): sums of the corrections, partial ones. At most about `pairs` pairs are worked on at once, `held` sums remembered."""
    ordered = rated.select("lang", "term", "source", "p", "p0").repartition(partitions(rated.sparkSession), "lang", "term").sortWithinPartitions("lang", "term")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], int] = {}
        names: list[tuple[str, str]] = []
        sums: dict[int, int] = {}
        rest: pa.Table | None = None

        def flush() -> pa.RecordBatch:
            codes = list(sums)
            a, b = [names[c >> 32] for c in codes], [names[c & 0xFFFFFFFF] for c in codes]
            batch = pa.record_batch(
                [pa.array([x[0] for x in a], pa.string()), pa.array([x[1] for x in a], pa.string()), pa.array([x[1] for x in b], pa.string()), pa.array(list(sums.values()), pa.int64())],
                ["lang", "source", "item", "value"],
            )
            sums.clear()
            return batch

        def add(table: pa.Table) -> Iterator[pa.RecordBatch]:
            terms, lang = table.column("term").combine_chunks(), table.column("lang").combine_chunks()
            new = np.r_[True, _changes(lang) | _changes(terms)]
            start = np.flatnonzero(new)
            size = np.diff(np.r_[start, len(new)])
            own = np.cumsum(new) - 1
            group = np.empty(len(new), np.int64)
            for k, pair in enumerate(zip(lang.to_pylist(), table.column("source").to_pylist(), strict=True)):
                if pair not in groups:
                    groups[pair] = len(names)
                    names.append(pair)
                group[k] = groups[pair]
            p, p0 = table.column("p").to_numpy(), table.column("p0").to_numpy()
            each = size[own]
            ends = np.cumsum(each)
            at = 0
            while at < len(new):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + pairs, "right")))
                i = np.repeat(np.arange(at, to), each[at:to])
                j = gather(start[own[at:to]], each[at:to], np.arange(len(new)))
                i, j = i[group[i] != group[j]], j[group[i] != group[j]]
                f = lambda x, y: (x - y) * (x - y) // y
                value = f(p[i], p[j]) - f(p[i], p0[j]) - f(p0[i], p[j]) + f(p0[i], p0[j])
                code, place = np.unique(group[i] << 32 | group[j], return_inverse=True)
                found = np.zeros(len(code), np.int64)
                np.add.at(found, place, value)
                for c, v in zip(code.tolist(), found.tolist(), strict=True):
                    sums[c] = sums.get(c, 0) + v
                if len(sums) > held:
                    yield flush()
                at = to

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            if not table.num_rows:
                continue
            new = np.flatnonzero(_changes(table.column("lang").combine_chunks()) | _changes(table.column("term").combine_chunks()))
            cut = int(new[-1]) + 1 if len(new) else 0  # the last term may go on in the next batch
            rest = table.slice(cut)
            if cut:
                yield from add(table.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield from add(rest)
        yield flush()

    return ordered.mapInArrow(stream, "lang string, source string, item string, value bigint")


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before."""
    return pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False).astype(bool)
