"""Token ids as binary shards with Elias-Fano document boundaries.

A shard is two files: `ids-N.bin`, the ids of its documents in a row at 2 bytes an id (4 where the vocabulary or the
end id needs them; an id that does not fit is an error, never cut), and `bounds-N.ef`, the document boundaries and the document numbers, both monotone, as Elias-Fano
codes. Such a code keeps the low bits of each value in a packed array and the high bits in unary, about
2 + log2(range / count) bits a value; a count of ones per 512 bits of the unary part lets `select` find a value
without a table of 64-bit offsets. Shards hold ascending, disjoint ranges of document numbers, so a shard's first
place in the whole id array is the sum of the shards before it.

Null or empty text: only the end id. Null document numbers: in front of all others. Repeated rows: each is
written. No rows: no shard. Other columns of the input are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vintagerisk.llm.chunks import LibraryEncoder, loaded
from vintagerisk.llm.files import opened, replacing, whole
from vintagerisk.llm.frames import partitions, pick

MAGIC = b"EFTOKEN1"
BLOCK = 64  # bytes of the unary part per entry of the count directory


class EliasFano:
    """A non-decreasing list of integers; select(i) gives the i-th value."""

    def __init__(self, n: int, base: int, low_bits: int, low: np.ndarray, high: np.ndarray, counts: np.ndarray) -> None:
        self.n, self.base, self.low_bits, self.low, self.high, self.counts = n, base, low_bits, low, high, counts

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        base = int(values[0]) if n else 0
        rest = (values.astype(np.int64) - base).astype(np.uint64)  # wraps rightly for any pair of 64-bit integers
        span = int(rest[-1]) if n else 0
        bits = max(0, (span // max(n, 1)).bit_length() - 1)
        lows = ((rest[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        place = (rest >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = -(-(int(place[-1]) + 1 if n else 0) // (8 * BLOCK)) * BLOCK
        high = np.zeros(size, np.uint8)
        np.bitwise_or.at(high, place >> 3, (1 << (place & 7)).astype(np.uint8))
        ones = np.unpackbits(high).reshape(-1, 8 * BLOCK).sum(1, dtype=np.int64)
        return cls(n, base, bits, np.packbits(lows, bitorder="little"), high, np.cumsum(np.r_[0, ones])[:-1].astype(np.uint32))

    def select(self, at: np.ndarray) -> np.ndarray:
        at = np.asarray(at, np.int64)
        out = np.empty(len(at), np.int64)
        for k in range(0, len(at), 2048):
            i = at[k : k + 2048]
            block = np.searchsorted(self.counts, i, "right") - 1
            bits = np.unpackbits(self.high.reshape(-1, BLOCK)[block], axis=1, bitorder="little")
            inside = (np.cumsum(bits, 1, dtype=np.int32) > (i - self.counts[block])[:, None]).argmax(1)
            value = ((block * 8 * BLOCK + inside - i).astype(np.uint64)) << np.uint64(self.low_bits)
            if self.low_bits:
                where = i[:, None] * self.low_bits + np.arange(self.low_bits)
                low = (self.low[where >> 3] >> (where & 7).astype(np.uint8)) & 1
                value |= (low.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
            out[k : k + 2048] = value.astype(np.int64) + self.base
        return out

    def to_bytes(self) -> bytes:
        parts = [self.low.tobytes(), self.high.tobytes(), self.counts.astype("<u4").tobytes()]
        return struct.pack("<qqBqqq", self.n, self.base, self.low_bits, *map(len, parts)) + b"".join(parts)

    @classmethod
    def read(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        n, base, bits, *sizes = struct.unpack_from("<qqBqqq", data, at)
        at += struct.calcsize("<qqBqqq")
        parts = []
        for size, kind in zip(sizes, ("u1", "u1", "<u4"), strict=True):
            parts.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
            at += size
        return cls(n, base, bits, *parts), at


MANIFEST = T.StructType([T.StructField("shard", T.LongType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType())])
DOCUMENT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType())])


def width_for(tokenizer_json: str, end_id: int, width: int | None = None) -> int:
    """Bytes an id; a width asked for must hold every id of the vocabulary and the end id."""
    from tokenizers import Tokenizer

    highest = max(end_id, *Tokenizer.from_str(tokenizer_json).get_vocab(with_added_tokens=True).values())
    least = 2 if highest < 1 << 16 else 4
    if end_id < 0 or width not in (None, 2, 4) or (width or 4) < least:
        raise ValueError(f"ids up to {highest}, end id {end_id}: not to be written at {width} bytes")
    return width or least


def write_shards(
    docs: DataFrame, folder: str, tokenizer_json: str, end_id: int, width: int | None = None, shards: int | None = None, doc_id: str = "doc_id", text: str = "text"
) -> None:
    """Encode `docs` and write them in ascending order of their numbers. width: bytes an id, 2 or 4; unless given, as the vocabulary asks."""
    spark = docs.sparkSession
    width = width_for(tokenizer_json, end_id, width)
    told = spark.sparkContext.broadcast(tokenizer_json)  # the size of a vocabulary file

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        batch = next((b for b in batches if b.num_rows), None)
        if batch is None:
            return
        encode = loaded(LibraryEncoder, told.value)
        sizes, numbers, nulls = [np.zeros(1, np.int64)], [], 0
        with replacing(f"{folder}/ids-{shard:08d}.bin") as out:
            while batch is not None:
                number = batch.column(0).drop_null()
                nulls += batch.num_rows - len(number)
                numbers.append(number.to_numpy())
                for _, (offsets, ids) in encode.batches(batch.column(1)):
                    ids = np.insert(ids, offsets[1:], end_id)
                    if width < 4 and int(ids.max()) >> (8 * width):
                        raise OverflowError(f"id {int(ids.max())} does not fit in {width} bytes")
                    out.write(ids.astype(f"<u{width}").tobytes())
                    sizes.append(np.diff(offsets) + 1)
                batch = next(batches, None)
        sizes, numbers = np.concatenate(sizes), np.concatenate(numbers)
        bounds = np.cumsum(sizes)
        with replacing(f"{folder}/bounds-{shard:08d}.ef") as out:
            out.write(MAGIC + struct.pack("<Bq", width, nulls))
            out.write(EliasFano.of(bounds).to_bytes() + EliasFano.of(numbers).to_bytes())
        yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [len(sizes) - 1], "n_ids": [int(bounds[-1])]})

    rows = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    ordered = rows.repartitionByRange(shards or partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (little-endian 32-bit), from the files alone."""
    base, rows = 0, []
    for m in spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").orderBy("shard").collect():  # a row per shard
        rows.append((m.shard, base))
        base += m.n_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from documents(folder, shard, first)

    if not rows:
        return spark.createDataFrame([], DOCUMENT)
    listed = spark.createDataFrame(rows, "shard long, base long").repartition(len(rows), "shard")
    return listed.mapInArrow(read, DOCUMENT)


def documents(folder: str, shard: int, first: int, step_ids: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    data = whole(f"{folder}/bounds-{shard:08d}.ef")
    width, nulls = struct.unpack_from("<Bq", data, len(MAGIC))
    bounds, at = EliasFano.read(data, len(MAGIC) + 9)
    numbers, _ = EliasFano.read(data, at)
    with opened(f"{folder}/ids-{shard:08d}.bin") as f:
        i, n = 0, bounds.n - 1
        while i < n:
            places = bounds.select(np.arange(i, min(i + 1024, n) + 1))
            take = max(1, int(np.searchsorted(places, places[0] + step_ids, "right")) - 1)  # whole documents, about a million ids at once
            take = min(take, len(places) - 1)
            f.seek(int(places[0]) * width)
            ids = np.frombuffer(f.read(int(places[take] - places[0]) * width), f"<u{width}").astype("<u4")
            own = np.arange(i, i + take)
            named = numbers.select(own[own >= nulls] - nulls).tolist()
            cuts = places[: take + 1] - places[0]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([None] * (take - len(named)) + named, pa.int64()),
                    "start": pa.array(first + places[:take], pa.int64()),
                    "ids": pa.array([ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                }
            )
            i += take
