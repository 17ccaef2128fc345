"""Line deduplication that can be taken back: documents are inserted and deleted batch by batch.

A store keeps, in the shared folder,

* references: (key, document), one for each distinct key of a row, 24 bytes each;
* exact counts: per key its references and the smallest and largest document that hold it;
* cuckoo filters, sharded by key, over the keys that have counts.

An inserted batch is counted on its own. Its keys then ask the filters: a key that no filter knows is new, and its counts
are appended without a look at the exact table; only the others are joined with it. Deleting documents removes their
references, counts the keys they held again, and takes keys that nobody holds any more out of the filters. Afterwards
the store is as if the documents had never come.

Text is split at each line feed. The key of a line is the line without white space (`[\\x20\\x09-\\x0D]`) at its ends, A-Z
lower-cased, known by the first 128 bits of its SHA-256. A key of at least `least` code points that at least two
documents hold is dropped from all of them but the one with the smallest number.

Null or empty text is one empty line. Rows with the same number are one document, and rows without a number are one document
behind all others; each row is returned. A line that repeats inside one document only stays. Further columns are not
passed on. An empty table gives no rows. A hot key is pre-aggregated before it is counted, and its references are on the
side of the final join that Spark splits.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintagerisk.llm import files
from vintagerisk.llm.cuckoo import CuckooFilter, FilterChain
from vintagerisk.llm.frames import land, partitions, scratch, sliced

LEAST = 10
SPACE = " \t\n\x0b\x0c\r"
LAST = (1 << 63) - 1  # stands for a missing document number
KEY = ["hi", "lo"]
REFS, COUNTS, FILTERS = "hi bigint, lo bigint, doc bigint", "hi bigint, lo bigint, n_refs bigint, first_doc bigint, last_doc bigint", "shard bigint, level int, payload binary"


def numbered(doc_id: str) -> str:
    return f"coalesce(cast(`{doc_id}` as bigint), {LAST}L)"


class Lines:
    """The lines of a column of texts: `text` and `key` each, first line of each row in `starts`."""

    def __init__(self, texts: pa.Array) -> None:
        split = pc.split_pattern(pc.fill_null(texts.cast(pa.string()), ""), "\n")
        self.starts = np.asarray(split.offsets, np.int64)
        self.text = split.values.slice(int(self.starts[0]), int(self.starts[-1] - self.starts[0]))
        self.starts = self.starts - self.starts[0]
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.starts))
        self.key = pc.ascii_lower(pc.ascii_trim(self.text, characters=SPACE))

    def digests(self, rows: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the lines of these rows whose key is long enough, their digests as two long columns)."""
        long = pc.greater_equal(pc.utf8_length(self.key), least).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(long & rows[self.row])
        coded = self.key.take(pa.array(at)).dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary()).to_pylist()
        digest = np.frombuffer(b"".join(hashlib.sha256(k).digest()[:16] for k in distinct), np.int64).reshape(-1, 2)
        return at, digest[np.asarray(coded.indices, np.int64)]


def references(docs: DataFrame, least: int = LEAST, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(hi, lo, doc): the distinct keys of each row."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            lines = Lines(batch.column("text"))
            at, digest = lines.digests(np.ones(batch.num_rows, bool), least)
            each = np.unique(np.column_stack([lines.row[at], digest]), axis=0) if len(at) else np.zeros((0, 3), np.int64)
            doc = batch.column("doc").to_numpy()[each[:, 0]]
            yield pa.record_batch([pa.array(each[:, 1]), pa.array(each[:, 2]), pa.array(doc)], ["hi", "lo", "doc"])

    return docs.selectExpr(f"{numbered(doc_id)} AS doc", f"cast(`{text}` as string) AS text").mapInArrow(split, REFS)


def counted(refs: DataFrame) -> DataFrame:
    return refs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_refs"), F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"))


def with_filters(filters: DataFrame, keys: DataFrame, shards: int, capacity: int, work: str) -> DataFrame:
    """Let each shard's keys meet its filters. work `ask`: keys with `maybe`; `add`, `remove`: the changed filters.

    The filters of a shard come before its keys, so a task holds one shard's filters and a batch of keys.
    """
    held = filters.selectExpr("shard", "0 AS kind", "level", "payload", "0L AS hi", "0L AS lo")
    asking = keys.selectExpr(f"pmod(hi, {shards}L) AS shard", "1 AS kind", "0 AS level", "cast(NULL AS binary) AS payload", *KEY)
    met = held.unionByName(asking).repartition(partitions(keys.sparkSession), "shard").sortWithinPartitions("shard", "kind", "level")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, chain = None, FilterChain(capacity)

        def changed() -> pa.RecordBatch:
            n = len(chain.filters)
            rows = [pa.array([shard] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([f.dump() for f in chain.filters], pa.binary())]
            return pa.record_batch(rows, ["shard", "level", "payload"])

        for batch in batches:
            ids, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero(np.r_[True, (np.diff(ids) != 0) | (np.diff(kind) != 0), True]) if len(ids) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if ids[a] != shard:
                    if work != "ask" and shard is not None:
                        yield changed()
                    shard, chain = int(ids[a]), FilterChain(capacity)
                if kind[a] == 0:
                    chain.filters += [CuckooFilter.load(x.as_py()) for x in batch.column("payload").slice(a, b - a)]
                    continue
                hi, lo = batch.column("hi").to_numpy()[a:b], batch.column("lo").to_numpy()[a:b]
                if work == "ask":
                    yield pa.record_batch([pa.array(hi), pa.array(lo), pa.array(chain.contains(hi, lo))], ["hi", "lo", "maybe"])
                else:
                    getattr(chain, work)(hi, lo)
        if work != "ask" and shard is not None:
            yield changed()

    return met.mapInArrow(meet, "hi bigint, lo bigint, maybe boolean" if work == "ask" else FILTERS)


class LineStore:
    """References, counts and filters of the documents inserted so far. `folder` has them all, so `LineStore(spark, folder)` opens them again.

    shards: of the filters, fixed when the store is made; a shard's filters should fit a task (2.4 bytes a key).
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, shards: int | None = None, least: int = LEAST, capacity: int = 1 << 15) -> None:
        self.spark, self.folder = spark, (folder or scratch(spark, "lines")).rstrip("/")
        self.settings = {"shards": shards or 2 * partitions(spark), "least": least, "capacity": capacity}
        self.tables: dict[str, list[str]] = {"refs": [], "counts": [], "filters": []}
        try:
            state = json.loads(files.whole(f"{self.folder}/state.json"))
        except FileNotFoundError:
            return
        self.settings, self.tables = state["settings"], state["tables"]

    def _read(self, kind: str) -> DataFrame:
        schema = {"refs": REFS, "counts": COUNTS, "filters": FILTERS}[kind]
        paths = self.tables[kind]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, kind: str) -> str:
        path = scratch(self.spark, f"lines-{kind}")
        df.write.parquet(path)
        return path

    def _commit(self, **tables: list[str]) -> None:
        """A change becomes visible at once, after all its tables are written."""
        self.tables = self.tables | tables
        with files.replacing(f"{self.folder}/state.json") as out:
            out.write(json.dumps({"settings": self.settings, "tables": self.tables}).encode())

    def _met(self, keys: DataFrame, work: str) -> DataFrame:
        return with_filters(self._read("filters"), keys, self.settings["shards"], self.settings["capacity"], work)

    @property
    def counts(self) -> DataFrame:
        return self._read("counts")

    def insert(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> None:
        batch = self._write(references(docs, self.settings["least"], text, doc_id), "refs")
        fresh = counted(self.spark.read.schema(REFS).parquet(batch))
        if self.tables["counts"]:
            fresh = land(fresh, "fresh-lines")
            asked = land(self._met(fresh, "ask"), "asked-lines")
            unseen = fresh.join(asked.where("NOT maybe"), KEY).drop("maybe")
            looked_up = fresh.join(asked.where("maybe"), KEY).drop("maybe")
            names = {c: f"new_{c}" for c in ("n_refs", "first_doc", "last_doc")}
            both = self.counts.join(looked_up.withColumnsRenamed(names), KEY, "full_outer")
            after = land(both.select(
                *KEY, F.expr("n_refs IS NULL AS first_seen"), (F.coalesce("n_refs", F.lit(0)) + F.coalesce("new_n_refs", F.lit(0))).alias("n_refs"),
                F.least("first_doc", "new_first_doc").alias("first_doc"), F.greatest("last_doc", "new_last_doc").alias("last_doc"),
            ), "lines-after")
            new = unseen.select(*KEY).unionByName(after.where("first_seen").select(*KEY))
            counts = [self._write(after.drop("first_seen").unionByName(unseen), "counts")]
        else:
            counts = [self._write(fresh, "counts")]
            new = self.spark.read.schema(COUNTS).parquet(*counts)
        filters = self._write(self._met(new, "add"), "filters")
        self._commit(refs=[*self.tables["refs"], batch], counts=counts, filters=[filters])

    def delete(self, doc_ids: DataFrame, doc_id: str = "doc_id") -> None:
        """Take the documents with these numbers out; a null number stands for the rows without one."""
        gone = doc_ids.selectExpr(f"{numbered(doc_id)} AS doc").distinct()
        refs = self._read("refs")
        touched = land(refs.join(gone, "doc", "left_semi").select(*KEY).distinct(), "touched-lines")
        left = self._write(refs.join(gone, "doc", "left_anti"), "refs")
        again = land(counted(self.spark.read.schema(REFS).parquet(left).join(touched, KEY, "left_semi")), "counted-again")
        counts = self._write(self.counts.join(touched, KEY, "left_anti").unionByName(again), "counts")
        filters = self._write(self._met(touched.join(again, KEY, "left_anti"), "remove"), "filters")
        self._commit(refs=[left], counts=[counts], filters=[filters])

    def cleaned(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
        """(doc_id, n_lines, n_dropped, text) of documents of the store: their lines without those an earlier document holds."""
        least = self.settings["least"]
        shared = land(self.counts.where("first_doc < last_doc").select(*KEY, "first_doc"), "shared-lines")
        drops = self._read("refs").join(shared, KEY).where("doc > first_doc").groupBy("doc").agg(F.collect_set(F.struct(*KEY)).alias("keys"))
        rows = docs.selectExpr(f"`{doc_id}` AS doc_id", f"{numbered(doc_id)} AS doc", f"cast(`{text}` as string) AS text").join(land(drops, "dropped-lines"), "doc", "left")

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, "text"):
                lines, keys = Lines(batch.column("text")), batch.column("keys")
                at, digest = lines.digests(keys.is_valid().to_numpy(zero_copy_only=False), least)
                sets = {k: {(s["hi"], s["lo"]) for s in keys[k].as_py()} for k in np.unique(lines.row[at]).tolist()}
                stays = np.ones(len(lines.row), bool)
                stays[at] = [pair not in sets[r] for r, pair in zip(lines.row[at].tolist(), map(tuple, digest.tolist()), strict=True)]
                n = np.diff(lines.starts)
                held = np.r_[0, np.cumsum(stays)][lines.starts]
                listed = pa.ListArray.from_arrays(pa.array(held, pa.int32()), lines.text.filter(pa.array(stays)))
                yield pa.record_batch(
                    [batch.column("doc_id"), pa.array(n), pa.array(n - np.diff(held)), pc.binary_join(listed, "\n")], ["doc_id", "n_lines", "n_dropped", "text"]
                )

        kind = dict(docs.dtypes)[doc_id]
        return rows.select("doc_id", "text", "keys").mapInArrow(drop, f"doc_id {kind}, n_lines bigint, n_dropped bigint, text string")
