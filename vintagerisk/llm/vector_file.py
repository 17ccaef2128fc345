"""Exact top-k inner-product search by a vector-approximation file.

Each component x becomes the integer floor(1024 * x). The file holds, per distinct vector, its quantised cells (256 equal
cells over the range of all components), its exact integers, and the smallest row numbers that carry it, k + 1 of them at
most: more copies than that can never be in a list of k. A first scan reads cells only; the cell edges bound each inner
product from both sides, and the k-th largest lower bound over all tasks is a score that the k-th result reaches for sure.
A second scan takes the vectors whose upper bound reaches it, in order of that bound, and computes exact products until
the k-th best exceeds the next bound. Each task returns k rows a query at most, and a last ranking merges them.

Queries go in blocks of some `block` vectors, the only data that is broadcast; work is queries x vectors, as the search
asks, but in matrix products, and no pair leaves a task unless it may be in the result.

Null vectors, vectors with a null or non-finite component, and rows without a number take no part. Vectors of other
length than the query's are not compared with it. Rows that repeat number and vector count once; a number with two
vectors is two candidates and, if asked for, two queries; no row of the query's own number is its result. Ties go to the
smaller number. Fewer candidates than k: all of them. Empty vectors score 0. Products beyond 53 bits are computed in
Python integers and clipped to the range of a long before they are ranked. Columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagerisk.llm.frames import land, pick

CELLS = 256
SAFE = 2.0**53


def usable(vector: Column) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(fine(x), F.lit(False)))


def integers(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    rows = pick(vectors, vec_id=vec_id, v=vector).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x * 1024.0)).alias("v")).distinct()


def approximation_file(rows: DataFrame, k: int) -> tuple[DataFrame, int, int]:
    """(cells, v, ids) per distinct vector, the lowest component, the width of a cell."""
    first = rows.selectExpr("v", "vec_id", "row_number() OVER (PARTITION BY v ORDER BY vec_id) AS place").where(F.col("place") <= k + 1)
    distinct = land(first.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors")
    low, high = distinct.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    low, high = low or 0, high or 0
    step = (high - low) // CELLS + 1
    # beyond 2^53 every product is computed exactly, and the cells are of no use
    cells = f"transform(v, x -> CAST((x - ({low}L)) DIV {step}L AS smallint))" if max(-low, high) < 2**53 else "transform(v, x -> CAST(0 AS smallint))"
    return land(distinct.select(F.expr(cells).alias("cells"), "v", "ids"), "va-file"), low, step


def _matrix(column: pa.Array, rows: np.ndarray, dim: int, kind: type) -> np.ndarray:
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False))
    start = np.asarray(column.offsets, np.int64)[rows] - column.offsets[0].as_py()
    return values[start[:, None] + np.arange(dim)].astype(kind)


def clipped(score: int) -> int:
    return min(max(score, -(2**63) + 1), 2**63 - 1)


class Block:
    """A block of queries of one length, and their bounds."""

    def __init__(self, number: np.ndarray, ids: np.ndarray, q: np.ndarray, low: int, step: int) -> None:
        self.number, self.ids, self.q, self.low, self.step = number, ids, q, low, step
        self.slack = np.abs(q).sum(1) * (step - 1)
        self.under = np.minimum(q, 0).sum(1) * (step - 1)

    def lower(self, cells: np.ndarray) -> np.ndarray:
        """Queries x vectors; the upper bound is this plus `slack`. Exact in floats while they stay below 53 bits."""
        return self.q @ (cells * self.step + self.low).T + self.under[:, None]

    def wide(self) -> bool:
        reach = max(abs(self.low), abs(self.low + self.step * CELLS))
        return bool(len(self.q)) and np.abs(self.q).sum(1).max() * reach >= SAFE


def _slices(batch: pa.RecordBatch, dims: set[int], step: int = 2048) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.diff(np.asarray(batch.column("cells").offsets, np.int64))
    for dim in sorted(dims):
        rows = np.flatnonzero(sizes == dim)
        for k in range(0, len(rows), step):
            yield dim, rows[k : k + step]


def _owners(ids: pa.Array, rows: np.ndarray, block: Block) -> list[tuple[int, int]]:
    """(query, place in `rows`) where the query's own row is all there is of a vector."""
    sizes = np.diff(np.asarray(ids.offsets, np.int64))[rows]
    first = np.asarray(ids.flatten().to_numpy(zero_copy_only=False))[np.asarray(ids.offsets, np.int64)[rows] - ids.offsets[0].as_py()]
    single = np.where(sizes == 1, first, -1)
    known: dict[int, list[int]] = {}
    for place in np.flatnonzero((sizes == 1) & np.isin(first, block.ids)).tolist():
        known.setdefault(int(single[place]), []).append(place)
    return [(i, p) for i, q in enumerate(block.ids.tolist()) for p in known.get(q, ())]


def _scan_cells(batches: Iterator[pa.RecordBatch], blocks: dict[int, Block], k: int) -> Iterator[pa.RecordBatch]:
    best = {d: np.full((len(b.ids), k), -np.inf) for d, b in blocks.items()}
    for batch in batches:
        for dim, rows in _slices(batch, set(blocks)):
            block = blocks[dim]
            if block.wide():
                continue  # no float bound holds; the second scan then computes all products
            bound = block.lower(_matrix(batch.column("cells"), rows, dim, float))
            for i, place in _owners(batch.column("ids"), rows, block):
                bound[i, place] = -np.inf
            both = np.concatenate([best[dim], bound], 1)
            best[dim] = -np.partition(-both, k - 1, 1)[:, :k]
    for d, b in blocks.items():
        if np.isfinite(best[d]).any():
            yield pa.RecordBatch.from_pydict({"query": pa.array(b.number, pa.int64()), "bounds": pa.array([[x for x in r if np.isfinite(x)] for r in best[d]], pa.list_(pa.float64()))})


def _read_exact(batches: Iterator[pa.RecordBatch], blocks: dict[int, Block], reached: dict[int, float], k: int, chunk: int = 64) -> Iterator[pa.RecordBatch]:
    best: dict[tuple[int, int], list[tuple[int, int]]] = {}  # (length, query) -> up to k of (-score, vec_id), best first
    for batch in batches:
        ids = batch.column("ids")
        for dim, rows in _slices(batch, set(blocks)):
            block = blocks[dim]
            wide = block.wide()
            exact = _matrix(batch.column("v"), rows, dim, object if wide else float)
            upper = None if wide else block.lower(_matrix(batch.column("cells"), rows, dim, float)) + block.slack[:, None]
            for i in range(len(block.ids)):
                number, own, have = int(block.number[i]), int(block.ids[i]), best.setdefault((dim, i), [])
                least = reached.get(number, -np.inf)
                order = np.arange(len(rows)) if wide else np.flatnonzero(upper[i] >= least)
                if not wide:
                    order = order[np.argsort(-upper[i][order], kind="stable")]
                q = [int(x) for x in block.q[i]] if wide else block.q[i]
                for at in range(0, len(order), chunk):
                    if not wide and len(have) == k and -have[-1][0] > upper[i][order[at]]:
                        break  # no later vector can reach the k-th
                    part = order[at : at + chunk]
                    scores = [clipped(sum(a * int(b) for a, b in zip(q, exact[p], strict=True))) for p in part] if wide else (exact[part] @ q).tolist()
                    for p, score in zip(part.tolist(), scores, strict=True):
                        if len(have) == k and -score > have[-1][0]:
                            continue
                        have += [(-int(score), x) for x in ids[int(rows[p])].as_py() if x != own]
                        have.sort()
                        del have[k:]
    for (dim, i), have in best.items():
        if have:
            yield pa.RecordBatch.from_pydict({"query": pa.array([int(blocks[dim].number[i])] * len(have), pa.int64()), "query_id": pa.array([int(blocks[dim].ids[i])] * len(have), pa.int64()), "vec_id": pa.array([x for _, x in have], pa.int64()), "score": pa.array([-s for s, _ in have], pa.int64())})


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 1024, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of `vectors` for each row of `queries`."""
    spark = vectors.sparkSession
    file, low, step = approximation_file(integers(vectors, vec_id, vector), k)
    asked = land(integers(queries, vec_id, vector), "queries")
    pieces = max(1, -(-asked.count() // block))
    asked = asked.withColumn("piece", F.pmod(F.xxhash64("vec_id", "v"), F.lit(pieces)))
    found = None
    for piece in range(pieces):
        rows = asked.where(F.col("piece") == piece).orderBy("vec_id", "v").collect()  # some `block` rows
        by_size: dict[int, list[int]] = {}
        for n, r in enumerate(rows):
            by_size.setdefault(len(r.v), []).append(n)
        made = {d: Block(np.array(own), np.array([rows[n].vec_id for n in own]), np.array([rows[n].v for n in own], float).reshape(len(own), d), low, step) for d, own in by_size.items()}
        told = spark.sparkContext.broadcast(made)
        bounds = file.select("cells", "ids").mapInArrow(lambda b, told=told: _scan_cells(b, told.value, k), "query long, bounds array<double>")
        kth = bounds.groupBy("query").agg(F.sort_array(F.flatten(F.collect_list("bounds")), asc=False).alias("b")).where(F.size("b") >= k)
        reached = spark.sparkContext.broadcast({r.query: r.least for r in kth.select("query", F.col("b")[k - 1].alias("least")).collect()})
        best = file.mapInArrow(lambda b, told=told, reached=reached: _read_exact(b, told.value, reached.value, k), "query long, query_id long, vec_id long, score long")
        ranked = best.selectExpr("query_id", "CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS int) AS rank", "vec_id", "score").where(F.col("rank") <= k)
        ranked = land(ranked, "nearest")
        found = ranked if found is None else found.unionByName(ranked)
    return found
