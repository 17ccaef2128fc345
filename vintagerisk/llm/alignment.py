"""Which tokens of two tokenizers stand for the same places of a corpus, and how often.

A (a byte-level tokenizers file) encodes a space and the text, B (a SentencePiece BPE model) the text, which it
starts with a space itself; strings of special tokens are plain text. Byte offsets at which a token of both ends cut the
tokens into groups, and the two tokens that end there are linked. For each pair of ids, the count is its links in the whole corpus.

1. Each document is encoded once, and its ids are landed; nothing is encoded again.
2. The distinct pairs get minimal perfect hashes, one per shard of about `shard_pairs` pairs, with the pairs beside them.
3. As many tasks as the cluster runs at once add the links up in dense vectors, indexed by the hash, which are summed in a tree.
4. A second pass aligns the ids again and looks the counts up, by hash and verified pair.

Shards are dealt with in groups of `group_bytes`, read from the shared folder by the tasks that need them: memory
does not grow with the pairs, of which there are at most (ids of A) x (ids of B). The driver sees one number per id of B.

Null or empty texts, and texts whose joined token bytes differ from space and text (such as those with U+2581), have no
tokens: zeros and an empty digest. Each row is a document of its own, whatever its doc_id (nulls and repeats included);
all count. Further columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintagerisk.llm import files
from vintagerisk.llm.chunks import Ids, LibraryEncoder, byte_letters, gather, joined
from vintagerisk.llm.frames import scratch, sliced
from vintagerisk.llm.perfect_hash import PerfectHash

META = "▁"
SLICE = 1 << 20
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


class ByteTable:
    """The bytes of each id, flat."""

    def __init__(self, entries: list[bytes]) -> None:
        self.size = np.array([len(e) for e in entries], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(entries), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.start[ids], self.size[ids], self.flat)


class PlainEncoder(LibraryEncoder):
    """Tokenizer A: special tokens' strings in a text are plain text."""

    def __init__(self, tokenizer_json: str) -> None:
        super().__init__(tokenizer_json)
        self.limit = 120_000

    def _one(self, text: str) -> np.ndarray:
        self.tokenizer.encode_special_tokens = True
        try:
            return super()._one(text)
        finally:
            self.tokenizer.encode_special_tokens = False

    def bytes(self) -> ByteTable:
        value = {letter: b for b, letter in enumerate(byte_letters())}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        entries = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            entries[i] = bytes(value[c] for c in token) if all(c in value for c in token) else token.encode()
        return ByteTable(entries)


class PieceEncoder:
    """Tokenizer B. No piece has a space behind another character, so a text's pieces never cross the start of a run of spaces;
    what stands between two such starts is encoded apart, and short ones are remembered."""

    CHUNK = re.compile(r" +[^ ]*")
    LONE = "- -"  # stands for a lone space at the end of a text; no chunk has a space behind another character

    def __init__(self, model: bytes, limit: int = 120_000) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces = [self.library.id_to_piece(i) for i in range(self.library.vocab_size())]
        self.cuts = not any(META in p.lstrip(META) for p in self.pieces)
        self.limit = limit
        self._forget()

    def _forget(self) -> None:
        self.known = {self.LONE: 0}
        self.offsets, self.ids = np.array([0, 1]), np.array([self.library.piece_to_id(META)], np.uint32)

    def bytes(self) -> ByteTable:
        entries = []
        for i, piece in enumerate(self.pieces):
            byte = BYTE_PIECE.fullmatch(piece) if self.library.is_byte(i) else None
            entries.append(bytes([int(byte[1], 16)]) if byte else b"" if self.library.is_control(i) else piece.replace(META, " ").encode())
        return ByteTable(entries)

    def _distinct(self, chunks: list[str]) -> np.ndarray:
        """Places in `offsets` of the chunks, given without their first space."""
        new = [c for c in chunks if c not in self.known]
        if len(self.known) + len(new) > self.limit or len(self.ids) > 16 * self.limit:
            self._forget()
            new = [c for c in chunks if c not in self.known]
        if new:
            found = self.library.encode(new, num_threads=1)
            self.known.update(zip(new, range(len(self.offsets) - 1, len(self.offsets) - 1 + len(new)), strict=True))
            self.offsets = np.concatenate([self.offsets, len(self.ids) + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.uint32)])
        return np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))

    def encode(self, texts: pa.Array) -> Ids:
        if not self.cuts:
            return joined([np.array(ids, np.uint32) for ids in self.library.encode(texts.to_pylist(), num_threads=1)])
        odd = pc.match_substring_regex(texts, "^ |  | $").to_numpy(zero_copy_only=False).astype(bool)
        words = pc.split_pattern(texts, " ")
        if odd.any():  # runs of spaces belong to the chunk they start
            lists = words.to_pylist()
            for k in np.flatnonzero(odd).tolist():
                lists[k] = [c[1:] or self.LONE for c in self.CHUNK.findall(" " + texts[k].as_py())]
            words = pa.array(lists, pa.list_(pa.string()))
        coded = words.flatten().dictionary_encode()
        place = self._distinct(coded.dictionary.to_pylist())[np.asarray(coded.indices, np.int64)]
        start, size = self.offsets[place], self.offsets[place + 1] - self.offsets[place]
        rows = np.asarray(words.offsets, np.int64)
        return np.r_[0, np.cumsum(size)][rows - rows[0]], gather(start, size, self.ids)


_LOADED: dict[object, object] = {}


def once(key: object, make) -> object:
    """One object per Python worker, which Spark uses again for further tasks: of encoders and tables only the last is held."""
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = make()
    return _LOADED[key]


def encoders(tokenizer_json: str, model: bytes) -> tuple[PlainEncoder, PieceEncoder, ByteTable, ByteTable]:
    def make():
        a, b = PlainEncoder(tokenizer_json), PieceEncoder(model)
        return a, b, a.bytes(), b.bytes()

    return once((hash(tokenizer_json), hash(model)), make)


TOKENS = "doc_id {0}, a binary, b binary"


def tokens(docs: DataFrame, tokenizer_json: str, model: bytes, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, a, b): ids of each document in little-endian bytes, two an id where the vocabulary allows, empty where the two do not spell the text."""
    kind = dict(docs.dtypes)[doc_id]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok_a, tok_b, bytes_a, bytes_b = encoders(tokenizer_json, model)
        for batch in sliced(batches, "text", SLICE):
            texts = pc.fill_null(batch.column("text").cast(pa.string()), "")
            own = pc.binary_join_element_wise("", texts, " ")
            for _, (oa, ia) in tok_a.batches(own, 4 * SLICE + len(own)):
                ob, ib = tok_b.encode(texts)
                ends = np.r_[0, np.cumsum(pc.binary_length(own).to_numpy())]
                spelt = np.frombuffer(b"".join(own.cast(pa.binary()).to_pylist()), np.uint8)
                good = np.diff(ends) > 1
                for table, offsets, ids in ((bytes_a, oa, ia), (bytes_b, ob, ib)):
                    size = np.r_[0, np.cumsum(table.size[ids])][offsets]
                    same = np.diff(size) == np.diff(ends)
                    good &= same
                    if np.array_equal(size, ends):
                        wrong = np.flatnonzero(table.joined(ids) != spelt)
                        good[np.searchsorted(ends, wrong, "right") - 1] = False
                    else:
                        flat = table.joined(ids)
                        for k in np.flatnonzero(same).tolist():
                            good[k] &= np.array_equal(flat[size[k] : size[k + 1]], spelt[ends[k] : ends[k + 1]])
                ids_of = lambda offsets, ids, table: [ids[a:b].astype(id_type(len(table.size))).tobytes() if g else b"" for a, b, g in zip(offsets[:-1], offsets[1:], good, strict=True)]
                yield pa.record_batch(
                    [batch.column("doc_id"), pa.array(ids_of(oa, ia, bytes_a), pa.binary()), pa.array(ids_of(ob, ib, bytes_b), pa.binary())], ["doc_id", "a", "b"]
                )

    return docs.selectExpr(f"`{doc_id}` AS doc_id", f"cast(`{text}` as string) AS text").mapInArrow(encode, TOKENS.format(kind))


def id_type(vocabulary: int) -> np.dtype:
    """Little-endian, as wide as the vocabulary asks for."""
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


def flat_ids(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    size = pc.binary_length(column).to_numpy(zero_copy_only=False) // kind.itemsize
    return np.r_[0, np.cumsum(size)], np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.int64)


class Aligned:
    """The tokens of some documents in a row, with their common ends."""

    def __init__(self, batch: pa.RecordBatch, size_a: np.ndarray, size_b: np.ndarray) -> None:
        self.rows_a, self.a = flat_ids(batch.column("a"), id_type(len(size_a)))
        self.rows_b, self.b = flat_ids(batch.column("b"), id_type(len(size_b)))
        ends_a, ends_b = np.cumsum(size_a[self.a]), np.cumsum(size_b[self.b])
        marked = np.zeros((2, int(ends_a[-1]) + 1 if len(ends_a) else 1), bool)
        marked[0, ends_a] = marked[1, ends_b] = True
        self.cut_a, self.cut_b = marked[1, ends_a], marked[0, ends_b]
        self.row = np.repeat(np.arange(batch.num_rows), np.diff(self.rows_a))[self.cut_a]

    def links(self, ids_b: int) -> np.ndarray:
        """id of A x ids_b + id of B, of each link."""
        return self.a[self.cut_a] * ids_b + self.b[self.cut_b]

    def per_row(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.rows_a) - 1, np.int64)
        np.add.at(out, self.row, values)
        return out

    def digests(self) -> list[str]:
        """SHA-256 of `a1,a2|b1;a3|b2,b3` of each document: decimal ids, groups in order."""
        end_a, end_b = np.r_[0, np.cumsum(self.cut_a)], np.r_[0, np.cumsum(self.cut_b)]
        upto_a = np.r_[np.flatnonzero(self.cut_a) + 1, len(self.a)]
        from_b = np.r_[0, np.flatnonzero(self.cut_b) + 1]
        n = len(self.a) + len(self.b)
        ids, mark = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
        place_a = np.arange(len(self.a)) + from_b[end_a[:-1]]
        place_b = np.arange(len(self.b)) + upto_a[end_b[:-1]]
        ids[place_a], ids[place_b] = self.a, self.b
        mark[place_a[self.cut_a]], mark[place_b[self.cut_b]] = ord("|"), ord(";")
        digits = len(str(int(ids.max()))) if n else 1
        shown = np.empty((n, digits + 1), np.uint8)
        used = np.ones((n, digits + 1), bool)
        rest = ids
        for k in range(digits - 1, -1, -1):
            shown[:, k], used[:, k] = 48 + rest % 10, (rest > 0) | (k == digits - 1)
            rest = rest // 10
        shown[:, digits] = mark
        text = memoryview(shown[used].tobytes())
        ends = np.r_[0, np.cumsum(used.sum(1))][self.rows_a + self.rows_b].tolist()
        return [hashlib.sha256(text[a : b - 1]).hexdigest() if b > a else "" for a, b in zip(ends[:-1], ends[1:], strict=True)]


def aligned(batches: Iterator[pa.RecordBatch], size_a: np.ndarray, size_b: np.ndarray, bytes_at_once: int = SLICE // 2) -> Iterator[tuple[pa.RecordBatch, Aligned]]:
    for part in sliced(batches, "a", bytes_at_once):
        yield part, Aligned(part, size_a, size_b)


class PairTable:
    """The hashes of a group of shards, and their counts once these are known, read from the shared folder."""

    def __init__(self, uri: str, first: int, last: int, shards: int) -> None:
        system, path = files.locate(uri)
        rows = pq.read_table(path, filesystem=system, filters=[("shard", ">=", first), ("shard", "<=", last)]).to_pylist()
        self.first, self.last, self.shards = first, last, shards
        self.hashes = {r["shard"]: PerfectHash.load(*(r[c] for c in ("sizes", "words", "late", "keys"))) for r in rows}
        self.counts = {r["shard"]: unpacked(r["counts"]) for r in rows if "counts" in r}

    def parts(self, pairs: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, places in `pairs`, numbers by its hash) of the shards held."""
        shard = shard_of(pairs, self.shards)
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(self.first, self.last + 2))
        for k in range(self.first, self.last + 1):
            mine = order[edges[k - self.first] : edges[k - self.first + 1]]
            if len(mine):
                number = self.hashes[k].number(pairs[mine])
                if (number < 0).any():
                    raise LookupError("a linked pair is not in the table of its shard")
                yield k, mine, number


def packed(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.int64)


def shard_of(pairs: np.ndarray, shards: int) -> np.ndarray:
    x = pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


HASHES = "shard bigint, sizes binary, words binary, late binary, keys binary"
VECTORS = "shard bigint, node bigint, counts binary"


class Alignment:
    """Both passes over one corpus. `documents()` has a row per document."""

    def __init__(self, docs: DataFrame, tokenizer_json: str, model: bytes, text: str = "text", doc_id: str = "doc_id", shard_pairs: int = 1 << 17, group_bytes: int = 1 << 27, fan_in: int = 8) -> None:
        self.spark = docs.sparkSession
        _, _, bytes_a, bytes_b = encoders(tokenizer_json, model)
        self.size_a, self.size_b, self.fan_in = bytes_a.size, bytes_b.size, fan_in
        found = tokens(docs, tokenizer_json, model, text, doc_id).withColumn("row", F.monotonically_increasing_id())
        self.tokens = self._landed(found, "tokens")[1]
        pairs = self._landed(self._distinct_pairs(), "pairs")[1]
        self.shards = max(1, -(-pairs.count() // shard_pairs))
        self.hash_uri, _ = self._landed(self._hashed(pairs), "pair-hashes")
        per = max(1, group_bytes // (20 * shard_pairs))
        self.groups = [(k, min(k + per, self.shards) - 1) for k in range(0, self.shards, per)]
        self.table_uri, self.table = self._landed(self._counted(), "pair-counts")
        self.best = self._best()

    def _landed(self, df: DataFrame, name: str) -> tuple[str, DataFrame]:
        path = scratch(self.spark, name)
        df.write.parquet(path)
        return path, self.spark.read.schema(df.schema).parquet(path)

    def _distinct_pairs(self, held: int = 1 << 20) -> DataFrame:
        size_a, size_b = self.size_a, self.size_b

        def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _LOADED.clear()  # the encoders
            out = lambda found: pa.record_batch([pa.array(found)], ["pair"])
            seen = np.empty(0, np.int64)
            for _, x in aligned(batches, size_a, size_b):
                seen = np.union1d(seen, x.links(len(size_b)))
                if len(seen) > held:
                    yield out(seen)
                    seen = np.empty(0, np.int64)
            yield out(seen)

        return self.tokens.select("a", "b").mapInArrow(linked, "pair bigint").distinct()

    def _hashed(self, pairs: DataFrame) -> DataFrame:
        shards = self.shards

        def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.record_batch([pa.array(shard_of(batch.column("pair").to_numpy(), shards)), batch.column("pair")], ["shard", "pair"])

        def build(key: tuple, rows: pa.Table) -> pa.Table:
            own = PerfectHash.of(np.sort(rows.column("pair").to_numpy())).dump()
            return pa.table({"shard": [key[0].as_py()], **{k: pa.array([v], pa.binary()) for k, v in own.items()}})

        return pairs.mapInArrow(sharded, "shard bigint, pair bigint").groupBy("shard").applyInArrow(build, HASHES)

    def _counted(self) -> DataFrame:
        """The hashes with their dense count vectors."""
        summing = self.spark.sparkContext.defaultParallelism
        vectors = reduce(DataFrame.unionByName, [self._vectors(first, last, summing) for first, last in self.groups])
        width = summing * len(self.groups)
        while width > 1:
            width = -(-width // self.fan_in)
            vectors = vectors.withColumn("node", F.expr(f"node DIV {self.fan_in}")).groupBy("shard", "node").applyInArrow(_summed, VECTORS)
        hashes = self.spark.read.schema(HASHES).parquet(self.hash_uri)
        return hashes.join(vectors.select("shard", "counts"), "shard")

    def _vectors(self, first: int, last: int, tasks: int) -> DataFrame:
        uri, shards, size_a, size_b = self.hash_uri, self.shards, self.size_a, self.size_b

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = once((uri, first), lambda: PairTable(uri, first, last, shards))
            dense = {k: np.zeros(len(h.keys), np.int64) for k, h in table.hashes.items()}
            for _, x in aligned(batches, size_a, size_b):
                pairs, n = np.unique(x.links(len(size_b)), return_counts=True)
                for k, mine, number in table.parts(pairs):
                    dense[k][number] += n[mine]
            node = TaskContext.get().partitionId()
            for k, vector in dense.items():
                yield pa.record_batch([pa.array([k]), pa.array([node]), pa.array([packed(vector)])], ["shard", "node", "counts"])

        return self.tokens.select("a", "b").coalesce(tasks).mapInArrow(count, VECTORS)

    def _best(self) -> np.ndarray:
        """Highest count of each id of B; one number per id reaches the driver."""
        ids = len(self.size_b)

        def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = np.zeros(ids, np.int64)
            for batch in batches:
                for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                    np.maximum.at(best, np.frombuffer(keys, np.int64) % ids, unpacked(counts))
            at = np.flatnonzero(best)
            yield pa.record_batch([pa.array(at), pa.array(best[at])], ["b", "best"])

        found = self.table.select("keys", "counts").mapInArrow(highest, "b bigint, best bigint").groupBy("b").agg(F.max("best").alias("best")).toArrow()
        out = np.zeros(ids, np.int64)
        out[found.column("b").to_numpy()] = found.column("best").to_numpy()
        return out

    def pair_counts(self) -> DataFrame:
        """(a, b, n) of all linked pairs."""
        ids = len(self.size_b)

        def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                    pair = np.frombuffer(keys, np.int64)
                    yield pa.record_batch([pa.array(pair // ids), pa.array(pair % ids), pa.array(unpacked(counts))], ["a", "b", "n"])

        return self.table.select("keys", "counts").mapInArrow(spell, "a bigint, b bigint, n bigint")

    def documents(self) -> DataFrame:
        """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)."""
        parts = [self._looked_up(first, last, first == 0) for first, last in self.groups]
        if len(parts) == 1:
            return parts[0].drop("row")
        kept = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
        every = reduce(DataFrame.unionByName, parts).groupBy("row").agg(
            F.max("doc_id").alias("doc_id"), *[F.max(c).alias(c) for c in kept], F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")
        )
        return every.select(*parts[0].columns).drop("row")

    def _looked_up(self, first: int, last: int, leading: bool) -> DataFrame:
        uri, shards, size_a, size_b, best = self.table_uri, self.shards, self.size_a, self.size_b, self.best
        kind = dict(self.tokens.dtypes)["doc_id"]

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = once((uri, first), lambda: PairTable(uri, first, last, shards))
            for batch, x in aligned(batches, size_a, size_b):
                pairs, place = np.unique(x.links(len(size_b)), return_inverse=True)
                count = np.zeros(len(pairs), np.int64)
                for k, mine, number in table.parts(pairs):
                    count[mine] = table.counts[k][number]
                top = (count == best[pairs % len(size_b)]) & (count > 0)
                n = np.diff(x.rows_a), np.diff(x.rows_b), x.per_row(1)
                digest = x.digests() if leading else [""] * batch.num_rows
                columns = [*n, n[2], x.per_row(top[place].astype(np.int64)), x.per_row(count[place])]
                yield pa.record_batch([batch.column("row"), batch.column("doc_id"), *map(pa.array, columns), pa.array(digest, pa.string())], names)

        names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        longs = ", ".join(f"{c} bigint" for c in names[2:-1])
        return self.tokens.mapInArrow(look_up, f"row bigint, doc_id {kind}, {longs}, groups_sha256 string")


def _summed(key: tuple, rows: pa.Table) -> pa.Table:
    """At most `fan_in` vectors of one shard."""
    total = reduce(np.add, map(unpacked, rows.column("counts").to_pylist()))
    return pa.table({"shard": [key[0].as_py()], "node": [key[1].as_py()], "counts": pa.array([packed(total)], pa.binary())})
