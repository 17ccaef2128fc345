"""Packing of documents into sequences, best fit decreasing per partition, certified by lower bounds.

Documents longer than a sequence are cut into full pieces and a rest; full pieces are sequences of their own. All other
pieces are dealt over partitions of some `target` pieces, and each partition packs its pieces best fit decreasing. Dual-
feasible functions give a lower bound on the number of bins of a partition: each maps a length to a share of a bin so
that no bin holds shares of more than 1, so the sum of shares, rounded up, is a bound. A partition that meets its bound is
certified and done. Partitions with a gap put the pieces of their bins with room into a pool, which is dealt anew
over fewer partitions, and run again; a new packing of a pool is taken only if it needs fewer bins than before in all.

A partition's state is its list of lengths and piece numbers; texts and ids do not travel. Null or empty text: the end
id alone. Null or repeated document numbers: each row is packed as a document of its own. No rows: no sequences.
Other columns are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintagerisk.llm.chunks import LibraryEncoder, loaded
from vintagerisk.llm.frames import give_back, land, pick

CAPACITY = 2048
PIECES = "key long, doc_id long, piece int, start long, length long, ids_crc32 long"
BINS = "key long, part int, bin int, offset long, length long, bins int, bound int"


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place within it for each length: the fullest bin with enough room, longest pieces first."""
    bin_of, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    rooms: list[int] = []  # the rooms that some bin has, ascending
    by_room: dict[int, list[int]] = {}
    count = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        k = bisect.bisect_left(rooms, size)
        if k == len(rooms):
            room, b, count = capacity, count, count + 1
        else:
            room = rooms[k]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[k]
        bin_of[i], offset[i] = b, capacity - room
        left = room - size
        if left:
            if left not in by_room:
                by_room[left] = []
                bisect.insort(rooms, left)
            by_room[left].append(b)
    return bin_of, offset


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best bound of three families of dual-feasible functions over the sizes that occur."""
    if not len(lengths):
        return 0
    sizes, counts = np.unique(lengths, return_counts=True)
    best = -(-int((sizes * counts).sum()) // capacity)
    for e in sizes[sizes * 2 <= capacity].tolist():
        # more than capacity - e: a whole bin; less than e: nothing
        share = np.where(sizes > capacity - e, capacity, np.where(sizes < e, 0, sizes))
        best = max(best, -(-int((share * counts).sum()) // capacity))
        # pieces over half a bin count what is left of it in units of e
        whole = capacity // e
        share = np.where(2 * sizes > capacity, 2 * (whole - (capacity - sizes) // e), np.where(2 * sizes == capacity, whole, 2 * (sizes // e)))
        best = max(best, -(-int((share * counts).sum()) // (2 * whole)))
    for k in range(1, 33):
        # sizes rounded to k-ths: a share that is no exact multiple falls to the multiple below, of k in place of k + 1
        exact = (sizes * (k + 1)) % capacity == 0
        scaled = np.where(exact, sizes * k, ((sizes * (k + 1)) // capacity) * capacity)
        best = max(best, -(-int((scaled * counts).sum()) // (k * capacity)))
    return best


def pieces(
    docs: DataFrame, tokenizer_json: str, end_id: int, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text",
    known: int = 500_000, slice_bytes: int = 1 << 22,
) -> DataFrame:
    """key (a piece's own number), doc_id, piece, start, length, ids_crc32 of all pieces; landed, so that keys stay.

    known, slice_bytes: chunks a Python worker remembers and text it works on at once, the bounds of its memory.
    """
    told = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # the size of a vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(LibraryEncoder, told.value)
        encoder.limit = known
        for batch in batches:
            numbers = batch.column(0).to_pylist()
            for at, (offsets, ids) in encoder.batches(batch.column(1), slice_bytes):
                rows = []
                for i in range(len(offsets) - 1):
                    own = np.append(ids[offsets[i] : offsets[i + 1]], end_id).astype("<u4")
                    for k in range(0, len(own), capacity):
                        part = own[k : k + capacity]
                        rows.append((numbers[at + i], k // capacity, k, len(part), zlib.crc32(part.tobytes())))
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        give_back()

    rows = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    made = rows.mapInArrow(run, PIECES.removeprefix("key long, "))
    return land(made.select(F.monotonically_increasing_id().alias("key"), "*"), "pieces")


def _packed(pool: DataFrame, target: int, capacity: int) -> DataFrame:
    """Deal a pool (key, length) over partitions and pack each; every row knows its partition's bins and bound."""
    parts = max(1, round(pool.count() / target))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key")  # the same result whatever the order of arrival
        lengths = rows["length"].to_numpy()
        bin_of, offset = best_fit_decreasing(lengths, capacity)
        return pd.DataFrame({"key": rows["key"], "part": rows["part"], "bin": bin_of, "offset": offset, "length": lengths, "bins": int(bin_of.max()) + 1, "bound": lower_bound(lengths, capacity)})

    dealt = pool.select("key", "length", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part"))
    return land(dealt.groupBy("part").applyInPandas(pack, BINS), "packing")


def pack(pieces: DataFrame, capacity: int = CAPACITY, target: int = 50_000, rounds: int = 4) -> DataFrame:
    """key, sequence_id, offset of each of `pieces` (key, length).

    target: pieces a partition holds on average, the bound of a task's memory. rounds: how often partitions with a gap
    exchange their open bins; each time the pool is packed in a quarter of the partitions or fewer.
    """
    whole = pieces.where(F.col("length") >= capacity).select("key", F.lit(-1).alias("round"), F.lit(0).alias("part"), F.col("key").alias("bin"), F.lit(0).cast("long").alias("offset"))
    done = [whole]
    pool = pieces.where(F.col("length") < capacity).select("key", "length")
    packed = _packed(pool, target, capacity)
    for k in range(rounds):
        gaps = packed.where("bins > bound")
        room = gaps.groupBy("part", "bin").agg(F.sum("length").alias("used")).where(F.col("used") < capacity).select("part", "bin")
        opened = gaps.join(room, ["part", "bin"], "left_semi")
        before = opened.select("part", "bin").distinct().count()
        parts = gaps.select("part").distinct().count()
        if parts < 2:
            break
        again = _packed(opened.select("key", "length"), max(target, -(-opened.count() * 4 // parts)), capacity)
        after = again.groupBy("part").agg(F.max("bins").alias("bins")).agg(F.sum("bins")).first()[0] or 0
        if after >= before:
            break
        done.append(packed.join(opened.select("key"), "key", "left_anti").select("key", F.lit(k).alias("round"), "part", F.col("bin").cast("long").alias("bin"), "offset"))
        packed = again
    done.append(packed.select("key", F.lit(rounds).alias("round"), "part", F.col("bin").cast("long").alias("bin"), "offset"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return land(_numbered(out), "sequences")


def _numbered(rows: DataFrame) -> DataFrame:
    """A number for each (round, part, bin). Cut and full pieces take their key, all others a place above all keys."""
    packed = ((F.col("round") + 1).cast("long") * F.lit(1 << 26) + F.col("part")) * F.lit(1 << 32) + F.col("bin")
    return rows.select("key", F.when(F.col("round") < 0, -1 - F.col("bin")).otherwise(packed).alias("sequence_id"), "offset")


def packed_documents(
    docs: DataFrame, tokenizer_json: str, end_id: int, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text",
    known: int = 500_000, slice_bytes: int = 1 << 22,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: where each piece of each document stands."""
    made = pieces(docs, tokenizer_json, end_id, capacity, doc_id, text, known, slice_bytes)
    return made.join(pack(made.select("key", "length"), capacity), "key").drop("key")
